"""Queries of the retrieval family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text as fx
from tidewater.operators import retrieval as R
from tidewater.operators.index import Ask, TextIndex
from tidewater.plans.registry import query, table

_FOLD = "replace(replace(replace(translate(lower({0}), 'àáâãäåąćçèéêëęìíîïłñńòóôõöśùúûüýÿźż', 'aaaaaaacceeeeeiiiilnnooooosuuuuyyzz'), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"
_QUERY_SQL = "q AS (SELECT array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ') AS q FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))"


def _asked(spark, sf_dir):
    """The first twelve words of the first benchmark item: one row."""
    items = table(spark, sf_dir, "benchmark")
    return items.orderBy("item_id").limit(1).select(F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("q"))


_INDEXES: dict[tuple, TextIndex] = {}


def index_of(spark, sf_dir) -> TextIndex:
    """The documents' index: built on first use in a session, then read by every search; built anew if the files change."""
    docs = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(docs.inputFiles())))
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex.build(docs, "doc_id", "text")
    return _INDEXES[key]


def _terms(spark, sf_dir):
    """(doc_id, term, tf) for terms of two signs or more."""
    return index_of(spark, sf_dir).document_terms().where(F.length("term") >= 2).withColumnRenamed("id", "doc_id")


def _words(spark, sf_dir) -> str:
    return _asked(spark, sf_dir).first()["q"]


def _tfidf(spark, sf_dir):
    return R.tfidf(_terms(spark, sf_dir), index_of(spark, sf_dir).documents().count(), _asked(spark, sf_dir), "doc_id", "q")


_BM25_SQL = f"""{_QUERY_SQL},
 d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents),
 whole AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
 asked AS (SELECT term, count(*) AS qf FROM (SELECT unnest(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM q) GROUP BY 1),
 hits AS (SELECT doc_id, dl, term, qf, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) JOIN asked USING (term) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
 bm AS (SELECT doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score
        FROM hits JOIN df USING (term) CROSS JOIN whole GROUP BY 1)"""
_TFIDF_SQL = f"""{_QUERY_SQL},
 tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
 voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (count(*) + 1.0)) + 1.0 AS idf, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 5000),
 w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN voc USING (term)),
 qw AS (SELECT term, count(*) * any_value(idf) AS qw FROM (SELECT unnest(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM q) JOIN voc USING (term) GROUP BY 1),
 tfidf AS (SELECT doc_id, round(sum(w * coalesce(qw, 0)) / sqrt(sum(w * w)) / (SELECT sqrt(sum(qw * qw)) FROM qw), 6) AS score
           FROM w LEFT JOIN qw USING (term) GROUP BY 1 HAVING sum(w * coalesce(qw, 0)) > 0)"""
_KEYWORD_SQL = f"""{_QUERY_SQL}, a AS (SELECT list_distinct(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+')) AS asked FROM q),
 kw AS (SELECT doc_id, round(len(list_filter(asked, lambda t: contains(lower(text), t))) / len(asked), 6) AS score FROM documents CROSS JOIN a)"""


@query("tfidf_topk", f"WITH {_TFIDF_SQL} SELECT doc_id, score FROM tfidf WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5")
def tfidf_topk(spark, sf_dir):
    return R.top(_tfidf(spark, sf_dir), 5, "doc_id", least=0.0)


@query("bm25_topk", f"WITH {_BM25_SQL} SELECT doc_id, score FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf_dir):
    return index_of(spark, sf_dir).bm25(_words(spark, sf_dir), 10).withColumnRenamed("id", "doc_id")


@query("keyword_topk", f"WITH {_KEYWORD_SQL} SELECT doc_id, score FROM kw WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def keyword_topk(spark, sf_dir):
    return R.top(R.keyword(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), "doc_id", "text", "q"), 10, "doc_id", least=0.0)


@query(
    "lexical_overlap",
    f"""WITH {_QUERY_SQL}, f AS (SELECT conv_id, turn, list_distinct(regexp_extract_all({_FOLD.format('text')}, '[\\p{{L}}\\p{{N}}_]+')) AS own FROM conversations),
 a AS (SELECT list_distinct(regexp_extract_all({_FOLD.format('q')}, '[\\p{{L}}\\p{{N}}_]+')) AS asked FROM q)
 SELECT conv_id * 1000 + turn AS msg_id, CASE WHEN len(own) = 0 THEN 'unrepresentable' ELSE 'scored' END AS status,
 CASE WHEN len(own) > 0 THEN round(len(list_intersect(own, asked)) / len(asked), 6) END AS score FROM f CROSS JOIN a""",
)
def lexical_overlap(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    return R.overlap(messages, _asked(spark, sf_dir), "msg_id", "text", "q")


@query("like_search", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'apache') ORDER BY doc_id DESC LIMIT 50")
def like_search(spark, sf_dir):
    return R.like(table(spark, sf_dir, "documents"), ["license", "apache"], "text").select("doc_id", F.lit(1.0).alias("score")).orderBy(F.desc("doc_id")).limit(50)


@query(
    "fts_prefix_search",
    """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents),
 m AS (SELECT doc_id, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: starts_with(x, 'licen'))) AS b FROM d)
 SELECT doc_id, CAST(a AS BIGINT) AS exact_hits, CAST(b AS BIGINT) AS prefix_hits FROM m WHERE a > 0 AND b > 0""",
)
def fts_prefix_search(spark, sf_dir):
    rows = index_of(spark, sf_dir).postings([Ask("the"), Ask("licen", True)])
    hits = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("tf"))), F.lit(0))
    found = rows.groupBy(F.col("id").alias("doc_id")).agg(hits(F.col("term") == "the").alias("exact_hits"), hits(F.col("term").startswith("licen")).alias("prefix_hits"))
    return found.where("exact_hits > 0 and prefix_hits > 0")


_MATCH_SQL = """m AS (SELECT doc_id, len(list_filter(t, lambda x: x = 'of')) AS a, len(list_filter(t, lambda x: starts_with(x, 'th'))) AS b FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM d))
 SELECT doc_id, (a + b)::BIGINT AS hits FROM m WHERE a > 0 AND b > 0"""


@query("fts_match", f"WITH d AS (SELECT * FROM documents), {_MATCH_SQL}")
def fts_match(spark, sf_dir):
    """All words, the last a prefix."""
    return index_of(spark, sf_dir).match("of th*").withColumnRenamed("id", "doc_id")


@query(
    "fts_filtered",
    f"WITH {_BM25_SQL} SELECT doc_id, score, CASE WHEN instr(lower(text), 'the') > 0 THEN substring(text, greatest(instr(lower(text), 'the') - 60, 1), 10) ELSE substring(text, 1, 10) END AS head FROM (SELECT bm.* FROM bm JOIN documents USING (doc_id) WHERE lang = 'en' AND score > 0 ORDER BY score DESC, doc_id LIMIT 10) JOIN documents USING (doc_id)",
)
def fts_filtered(spark, sf_dir):
    """Search within one language, with the text around a hit."""
    docs = table(spark, sf_dir, "documents")
    found = index_of(spark, sf_dir).bm25(_words(spark, sf_dir), 10, docs.where("lang = 'en'").select(F.col("doc_id").alias("id"))).withColumnRenamed("id", "doc_id")
    at = F.instr(F.lower("text"), F.lit("the"))
    head = F.when(at > 0, F.substring(F.col("text"), F.greatest(at - 60, F.lit(1)), F.lit(10))).otherwise(F.substring("text", 1, 10))
    return found.join(docs, "doc_id").select("doc_id", "score", head.alias("head"))


@query("index_update", f"WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN text || ' of thimble' ELSE text END AS text FROM documents), {_MATCH_SQL}")
def index_update(spark, sf_dir):
    """An index of English documents that gets all others, and new texts of the English ones."""
    docs = table(spark, sf_dir, "documents")
    index = TextIndex.build(docs.where("lang = 'en'"), "doc_id", "text")
    index.update(docs.withColumn("text", F.when(F.col("lang") == "en", F.concat("text", F.lit(" of thimble"))).otherwise(F.col("text"))), "doc_id", "text")
    return index.match("of th*").withColumnRenamed("id", "doc_id")


@query("index_removal", f"WITH d AS (SELECT * FROM documents WHERE lang <> 'en' OR source = 'src1'), {_MATCH_SQL}")
def index_removal(spark, sf_dir):
    """Removed documents are found no more, unless they come back."""
    docs = table(spark, sf_dir, "documents")
    index = TextIndex.build(docs, "doc_id", "text")
    index.remove(docs.where("lang = 'en'"), "doc_id")
    index.update(docs.where("lang = 'en' and source = 'src1'"), "doc_id", "text")
    return index.match("of th*").withColumnRenamed("id", "doc_id")


@query(
    "regex_channel",
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{4,}')) + len(regexp_extract_all(text, '[A-Z]{3,}')) AS DOUBLE) AS match_count,
 CAST(regexp_matches(text, '[0-9]{4,}')::INT + regexp_matches(text, '[A-Z]{3,}')::INT AS DOUBLE) AS pattern_hits FROM documents""",
)
def regex_channel(spark, sf_dir):
    docs, patterns = table(spark, sf_dir, "documents"), ["[0-9]{4,}", "[A-Z]{3,}"]
    found = [F.regexp_like("text", F.lit(p)).cast("int") for p in patterns]
    count = [F.regexp_count("text", F.lit(p)) for p in patterns]
    return docs.select("doc_id", (count[0] + count[1]).cast("double").alias("match_count"), (found[0] + found[1]).cast("double").alias("pattern_hits"))


@query(
    "snippet",
    """WITH p AS (SELECT doc_id, text, instr(lower(text), 'license') AS a FROM documents), b AS (SELECT *, greatest(a - 60, 1) AS s FROM p)
 SELECT doc_id, CASE WHEN a > 0 THEN concat(CASE WHEN s > 1 THEN '...' ELSE '' END, substring(text, s, a - s), '[', substring(text, a, 7), ']', substring(text, a + 7, 60),
 CASE WHEN a + 67 <= length(text) THEN '...' ELSE '' END) ELSE substring(text, 1, 80) END AS snippet FROM b""",
)
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.snippet(F.col("text"), F.lit("license")).alias("snippet"))


@query(
    "embedding_topk",
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
 SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings CROSS JOIN q WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 20""",
)
def embedding_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return R.top(R.embedding(vectors.where("vec_id <> 0"), vectors.where("vec_id = 0"), "vec_id", "embedding"), 20, "vec_id")


def _channels(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    best = lambda scored: R.top(scored, 50, "doc_id", least=0.0)
    return [R.ranked(index_of(spark, sf_dir).bm25(_words(spark, sf_dir), 50).withColumnRenamed("id", "doc_id"), "bm25", "doc_id"), R.ranked(best(R.keyword(docs, asked, "doc_id", "text", "q")), "keyword", "doc_id")]


_CHANNELS_SQL = f"""WITH {_BM25_SQL}, {_KEYWORD_SQL[len(_QUERY_SQL) + 2 :]},
 c1 AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 50),
 c2 AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM kw WHERE score > 0 QUALIFY rank <= 50),
 u AS (SELECT 2.0 AS w, * FROM c1 UNION ALL SELECT 1.0 AS w, * FROM c2)"""


@query("rrf_fusion", f"{_CHANNELS_SQL} SELECT doc_id, round(sum(w::DOUBLE / (60 + rank)), 6) AS score, count(*) AS channels FROM u GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20")
def rrf_fusion(spark, sf_dir):
    return R.top(R.fuse(_channels(spark, sf_dir), {"bm25": 2.0, "keyword": 1.0}, "doc_id", "rrf"), 20, "doc_id")


@query("weighted_fusion", f"{_CHANNELS_SQL} SELECT doc_id, round(avg(w::DOUBLE * score), 6) AS score, count(*) AS channels FROM u GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20")
def weighted_fusion(spark, sf_dir):
    return R.top(R.fuse(_channels(spark, sf_dir), {"bm25": 2.0, "keyword": 1.0}, "doc_id", "mean"), 20, "doc_id")


@query(
    "cascade_decisions",
    f"""WITH {_KEYWORD_SQL}, s AS (SELECT doc_id, score AS lexical, round((n_chars % 101) / 100.0::DOUBLE, 6) AS vector, n_chars < 100 AS short, lang = 'es' AS es,
 CASE WHEN source = 'src7' THEN 'include' END AS manual FROM kw JOIN documents USING (doc_id))
 SELECT doc_id, CASE WHEN manual IS NOT NULL THEN manual WHEN short OR es THEN 'exclude' WHEN lexical >= 0.75 THEN 'include' WHEN lexical <= 0.25 THEN 'exclude'
  WHEN vector >= 0.75 THEN 'include' WHEN vector <= 0.25 THEN 'exclude' ELSE 'ambiguous' END AS decision,
  CASE WHEN manual IS NOT NULL THEN 'manual' WHEN short OR es THEN 'mask' WHEN lexical >= 0.75 OR lexical <= 0.25 THEN 'lexical' WHEN vector >= 0.75 OR vector <= 0.25 THEN 'vector' ELSE 'none' END AS level FROM s""",
)
def cascade_decisions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = R.keyword(docs, _asked(spark, sf_dir), "doc_id", "text", "q").withColumnRenamed("score", "lexical").join(docs.select("doc_id", "n_chars", "lang", "source"), "doc_id")
    masks = F.array_compact(F.array(F.when(F.col("n_chars") < 100, "short"), F.when(F.col("lang") == "es", "language")))
    rows = scored.select("doc_id", "lexical", F.round(F.col("n_chars") % 101 / 100.0, 6).alias("vector"), masks.alias("masks"), F.when(F.col("source") == "src7", "include").alias("manual"))
    return R.cascade(rows, "doc_id")


@query(
    "selection_precedence",
    """SELECT doc_id, CASE WHEN source = 'src9' THEN 'exclude' WHEN n_chars < 200 THEN 'exclude' WHEN lang = 'de' AND n_chars > 2000 THEN 'include' WHEN lang = 'en' THEN 'include' ELSE 'review' END AS decision,
 CASE WHEN source = 'src9' THEN 'override' WHEN n_chars < 200 THEN 'rule:short' WHEN lang = 'de' AND n_chars > 2000 THEN 'rule:long german' ELSE 'default' END AS decided_by FROM documents""",
)
def selection_precedence(spark, sf_dir):
    units = table(spark, sf_dir, "documents").withColumn("manual", F.when(F.col("source") == "src9", "exclude"))
    rules = [("short", F.col("n_chars") < 200, "exclude"), ("long german", (F.col("lang") == "de") & (F.col("n_chars") > 2000), "include")]
    return R.precedence(units, "manual", rules, "lang", {"en": "include", "de": "review", "fr": "review", "es": "review"}).select("doc_id", "decision", "decided_by")


_TF_SQL = "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{3,}')) AS term FROM documents) GROUP BY ALL)"


@query("term_stats", f"WITH {_TF_SQL} SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 3")
def term_stats(spark, sf_dir):
    index = _terms(spark, sf_dir).where(F.length("term") >= 3)
    return index.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).where("df >= 3")


@query(
    "salient_terms",
    f"""WITH {_TF_SQL}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
 w AS (SELECT doc_id, term, round((1 + ln(tf)) * ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)), 6) AS weight FROM tf JOIN df USING (term))
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank, term, weight FROM w QUALIFY rank <= 5""",
)
def salient_terms(spark, sf_dir):
    return R.salient(_terms(spark, sf_dir).where(F.length("term") >= 3), "doc_id", index_of(spark, sf_dir).documents().count(), 5)


@query(
    "vocab_expansion",
    f"""WITH {_TF_SQL}, h AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'license')), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), hn AS (SELECT count(*) AS h FROM h),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), dfh AS (SELECT term, count(*) AS dfh FROM tf SEMI JOIN h USING (doc_id) GROUP BY 1 HAVING count(*) >= 3),
 s AS (SELECT term, dfh, df, round((dfh / h) / (df / n), 6) AS lift, round(dfh / h * ln(1 + n / df), 6) AS score FROM dfh JOIN df USING (term) CROSS JOIN n CROSS JOIN hn)
 SELECT * FROM s WHERE lift > 1 ORDER BY score DESC, term LIMIT 25""",
)
def vocab_expansion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return R.expansion(_terms(spark, sf_dir).where(F.length("term") >= 3), R.like(docs, ["license"], "text").select("doc_id"), "doc_id", 25)


@query(
    "char_ngram_similarity",
    """WITH g AS (SELECT p_partkey, p_brand, unnest(list_transform(range(1, greatest(length(p_name) + 2 - 4 + 1, 1) + 1), lambda i: substring('_' || lower(p_name) || '_', i, 4))) AS feature FROM part),
 tf AS (SELECT p_partkey, p_brand, feature, 1 + ln(count(*)) AS t FROM g GROUP BY ALL), n AS (SELECT p_partkey, sqrt(sum(t * t)) AS n FROM tf GROUP BY 1),
 f AS (SELECT p_partkey, p_brand, feature, t / n AS w FROM tf JOIN n USING (p_partkey)), p AS (SELECT p_brand, feature, sum(w) AS p FROM f GROUP BY ALL), pp AS (SELECT p_brand, sum(p * p) AS pp FROM p GROUP BY 1),
 d AS (SELECT p_partkey, p_brand, sum(w * p) AS dot, sum(w * w) AS ww FROM f JOIN p USING (p_brand, feature) GROUP BY ALL)
 SELECT p_partkey, p_brand, round(CASE WHEN sqrt(greatest(pp - 2 * dot + ww, 0)) > 1e-9 THEN (dot - ww) / (sqrt(greatest(pp - 2 * dot + ww, 0)) * sqrt(ww)) ELSE 0 END, 6) AS score FROM d JOIN pp USING (p_brand)""",
)
def char_ngram_similarity(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    grams = part.select("p_partkey", "p_brand", F.explode(fx.char_ngrams(F.lower("p_name"), 4)).alias("feature")).groupBy("p_partkey", "p_brand", "feature").agg((1 + F.ln(F.count("*"))).alias("t"))
    norm = grams.groupBy("p_partkey").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("n"))
    return R.centroid_scores(grams.join(norm, "p_partkey").withColumn("w", F.col("t") / F.col("n")), "p_partkey", "p_brand")


@query(
    "semantic_candidates",
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS c FROM embeddings CROSS JOIN q)
 SELECT vec_id, c AS cosine, round(1 / (1 + exp(-(-1.5 + 4.0 * c))), 6) AS probability FROM s WHERE 1 / (1 + exp(-(-1.5 + 4.0 * c))) >= 0.5""",
)
def semantic_candidates(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    scored = R.embedding(vectors, vectors.where("vec_id = 1"), "vec_id", "embedding").withColumnRenamed("score", "cosine")
    p = fx.logistic(-1.5 + 4.0 * F.col("cosine"))
    return scored.where(p >= 0.5).select("vec_id", "cosine", F.round(p, 6).alias("probability"))


@query(
    "weighted_keyword_score",
    """WITH k(word, w) AS (VALUES ('license', 2.0), ('apache', 1.5), ('version', 1.0)), t AS (SELECT doc_id, n_chars, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents),
 s AS (SELECT doc_id, any_value(n_chars) AS n_chars, sum(w)::DOUBLE AS s FROM t JOIN k ON term = word GROUP BY 1)
 SELECT doc_id, CASE WHEN contains(d.text, '@') THEN 0.0 ELSE round(least(1.0, s / (3.0 * sqrt(greatest(1.0, s.n_chars / 2000.0)))), 6) END::DOUBLE AS score FROM s JOIN documents d USING (doc_id)""",
)
def weighted_keyword_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    weights = spark.createDataFrame([("license", 2.0), ("apache", 1.5), ("version", 1.0)], "term string, w double")
    hits = docs.select("doc_id", "n_chars", F.contains("text", F.lit("@")).alias("excluded"), F.explode(fx.tokens(F.col("text"))).alias("term")).join(F.broadcast(weights), "term")
    raw = hits.groupBy("doc_id", "n_chars", "excluded").agg(F.sum("w").alias("s"))
    scaled = F.least(F.lit(1.0), F.col("s") / (3.0 * F.sqrt(F.greatest(F.lit(1.0), F.col("n_chars") / 2000.0))))
    return raw.select("doc_id", F.when(F.col("excluded"), 0.0).otherwise(F.round(scaled, 6)).alias("score"))


@query(
    "more_like_this",
    """WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS t FROM part), q AS (SELECT t AS qt FROM t WHERE p_partkey = 0)
 SELECT p_partkey, round(len(list_intersect(t, qt)) / sqrt(len(t)::DOUBLE * len(qt)), 6) AS score FROM t CROSS JOIN q WHERE p_partkey <> 0 ORDER BY score DESC, p_partkey LIMIT 15""",
)
def more_like_this(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ")).alias("t"))
    asked = F.broadcast(terms.where("p_partkey = 0").select(F.col("t").alias("qt")))
    score = F.size(F.array_intersect("t", "qt")) / F.sqrt(F.size("t").cast("double") * F.size("qt"))
    return R.top(terms.where("p_partkey <> 0").join(asked).select("p_partkey", F.round(score, 6).alias("score")), 15, "p_partkey")
