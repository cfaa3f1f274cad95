"""Queries of sketches, candidate links and further duplicate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import heavy as H
from tidewater.operators import reports as P
from tidewater.operators import semantic as M
from tidewater.operators import similar as L
from tidewater.operators import sketches as K
from tidewater.plans.registry import query, table

_TERMS = r"t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{N}*\p{L}[\p{L}\p{N}+#]*')) AS term FROM documents)"


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(S.word_tokens(F.col("text"))).alias("term"))


@query("sketch_top_terms", f"WITH {_TERMS} SELECT doc_id, term, count(*) AS tf, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term)::INTEGER AS rank FROM t GROUP BY 1, 2 QUALIFY rank <= 20")
def sketch_top_terms(spark, sf_dir):
    return K.top_terms(_terms(spark, sf_dir), "doc_id", 20)


@query("heavy_terms", f"WITH {_TERMS.replace('SELECT doc_id,', 'SELECT source,')} SELECT source, term, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, term)::INTEGER AS rank FROM t GROUP BY 1, 2 QUALIFY rank <= 20")
def heavy_terms(spark, sf_dir):
    """The most frequent terms of each source, counted in bounded memory."""
    terms = table(spark, sf_dir, "documents").select("source", F.explode(S.word_tokens(F.col("text"))).alias("term"))
    return H.heavy_hitters(terms, ["source"], "term", 20).drop("error")


@query(
    "sketch_lookup",
    f"""WITH {_TERMS}, k AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) <= 20)
 SELECT d.doc_id, coalesce((SELECT tf FROM k WHERE k.doc_id = d.doc_id AND term = 'the'), 0) AS tf FROM documents d""",
)
def sketch_lookup(spark, sf_dir):
    """A term's count among a sketch's top terms; 0 where it isn't one."""
    sketch = K.top_terms(_terms(spark, sf_dir), "doc_id", 20).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("top"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.join(sketch, "doc_id", "left").select("doc_id", F.coalesce(F.element_at("top", F.lit("the")), F.lit(0).cast("long")).alias("tf"))


@query("sketch_meta", "SELECT doc_id, length(text) AS n_chars, strlen(text) > 4000 AS truncated, lang FROM documents")
def sketch_meta(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), (F.octet_length("text") > 4000).alias("truncated"), "lang")


@query("bloom_members", f"WITH {_TERMS} SELECT doc_id, count(DISTINCT term) AS n, count(DISTINCT term) AS found FROM t GROUP BY 1")
def bloom_members(spark, sf_dir):
    """Every term of a document is found in its filter."""
    sets = _terms(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("term").alias("t"))
    found = K.found_terms(F.col("t"), F.col("m"), F.col("k"), F.col("words")).cast("long")
    return sets.join(K.bloom_of_sets(sets, "doc_id", "t"), "doc_id").select("doc_id", F.size("t").cast("long").alias("n"), found.alias("found"))


@query("continuation_links")
def continuation_links(spark, sf_dir):
    """Band candidates of documents, verified on signatures; the tests hold them against all pairs."""
    d = table(spark, sf_dir, "documents").select("doc_id", K.minhash(S.word_tokens(F.col("text"))).alias("sig"))
    return K.band_links(d, "doc_id", "sig", 4, 0.5)


@query(
    "all_pairs_reference",
    r"""WITH s AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM (SELECT item_id, regexp_extract_all(lower(text), '\p{N}*\p{L}[\p{L}\p{N}+#]*') AS w FROM benchmark))
 SELECT a.item_id AS i, b.item_id AS j, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS strength FROM s a JOIN s b ON a.item_id < b.item_id WHERE strength >= 0""",
)
def all_pairs_reference(spark, sf_dir):
    """Exact similarity of all pairs of a table that is counted to be small."""
    w = table(spark, sf_dir, "benchmark").select("item_id", S.word_tokens(F.col("text")).alias("w"))
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice(F.col("w"), i, 3), " ")))
    return K.all_pairs(w.select("item_id", shingles.alias("s")), "item_id", K.jaccard, "s", 0.0)


@query(
    "ordered_links",
    """WITH l AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, 'same_project' AS type FROM supplier a JOIN supplier b USING (s_nationkey) WHERE i < j UNION ALL SELECT s_suppkey, s_suppkey + 1, 'same_session' FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier))
 SELECT i, j, type, row_number() OVER (ORDER BY i, j, CASE type WHEN 'same_project' THEN 1 ELSE 4 END) AS place FROM l QUALIFY place <= 300""",
)
def ordered_links(spark, sf_dir):
    """The first 300 links of the total order."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier")
    same = s.select(F.col("s_suppkey").alias("i"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("j"), "s_nationkey"), "s_nationkey").where("i < j").select("i", "j", F.lit("same_project").alias("type"))
    near = s.select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") + 1).alias("j")).join(s.select(F.col("s_suppkey").alias("j")), "j", "left_semi").select("i", "j", F.lit("same_session").alias("type"))
    first = K.in_order(same.unionByName(near)).limit(300)
    rank = F.array_position(F.array(*[F.lit(t) for t in K.RANKS]), F.col("type"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("i", "j", rank)).cast("long"))


@query(
    "source_reimports",
    "SELECT md5(text) AS digest, count(*) AS imports, max(n_chars) AS largest, sum(n_chars)::BIGINT AS total, array_to_string(list_sort(list(doc_id))[1:3], ',') AS examples FROM documents GROUP BY 1 HAVING count(*) >= 2",
)
def source_reimports(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("digest", F.md5("text"))
    return P.repeated(d, ["digest"], "n_chars", "doc_id", least=2, examples=3)


@query("duplicate_levels", "SELECT (props->>'$.k')::BIGINT // 10 AS level, count(*) AS links, count(DISTINCT user_id) AS units FROM events WHERE event_type = 'view' GROUP BY 1")
def duplicate_levels(spark, sf_dir):
    """Counts by a level that the link's JSON states."""
    level = F.floor(F.get_json_object("props", "$.k").cast("long") / 10)
    return table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(level.alias("level")).agg(F.count("*").alias("links"), F.countDistinct("user_id").alias("units"))


@query(
    "lineage_vote",
    """WITH v AS (SELECT l_partkey AS unit, l_suppkey AS revision, min(l_shipdate) AS date, sum(l_quantity * l_discount + CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS score FROM lineitem GROUP BY 1, 2)
 SELECT unit, revision, round(score, 4) AS score FROM v QUALIFY row_number() OVER (PARTITION BY unit ORDER BY round(score, 9) DESC, date, revision) = 1""",
)
def lineage_vote(spark, sf_dir):
    """The revision that a unit most likely comes from: weight times similarity, and the weight again where unchanged."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("revision"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("w"), F.col("l_discount").alias("similarity"), (F.col("l_returnflag") == "N").alias("unchanged"))
    return P.weighted_vote(v, "unit", "revision")


@query(
    "cluster_summary",
    rf"""WITH t AS (SELECT lang, doc_id, n_chars, unnest(regexp_extract_all(lower(text), '\p{{N}}*\p{{L}}[\p{{L}}\p{{N}}+#]*')) AS term FROM documents),
 c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) <= 8),
 p AS (SELECT lang, string_agg(term, ' ' ORDER BY n DESC, term) AS terms FROM c GROUP BY 1)
 SELECT lang, terms, count(*) AS units, min(n_chars) AS first, max(n_chars) AS last, array_to_string(list_sort(list(doc_id))[1:3], ',') AS samples FROM documents JOIN p USING (lang) GROUP BY ALL""",
)
def cluster_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    terms = d.select("lang", F.explode(S.word_tokens(F.col("text"))).alias("term"))
    return P.cluster_summary(d, terms, "lang", "doc_id", "n_chars", 8, 3)


@query("json_subtrees")
def json_subtrees(spark, sf_dir):
    """Repeated JSON subtrees, outermost only; the tests hold them against a plain walk."""
    e = table(spark, sf_dir, "events")
    nested = F.to_json(F.struct(F.struct("event_type", "props").alias("what"), F.col("user_id")))
    return P.repeated_subtrees(e.select("event_id", nested.alias("json")), "event_id", "json", least_bytes=20)


_COUNTS = r"""c AS (SELECT conv_id AS id, unnest(regexp_extract_all(lower(text), '\p{N}*\p{L}[\p{L}\p{N}+#]*')) AS term FROM conversations), n AS (SELECT id, term, count(*) AS n FROM c GROUP BY 1, 2)"""


def _conversation_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.explode(S.word_tokens(F.col("text"))).alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("n"))


@query(
    "term_links",
    f"""WITH {_COUNTS}, k AS (SELECT count(DISTINCT id) AS units FROM n), d AS (SELECT term, count(*) AS df FROM n GROUP BY 1 HAVING df >= 2 AND df <= CASE WHEN (SELECT units FROM k) > 2 THEN greatest(1, (SELECT units FROM k) // 2) ELSE (SELECT units FROM k) END),
 r AS (SELECT id, term, round(n * ln(1 + (SELECT units FROM k) / df), 9) AS raw FROM n JOIN d USING (term)),
 v AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY raw DESC, term) <= 8),
 l AS (SELECT id, list((term, round(w, 9)) ORDER BY term) AS l FROM v GROUP BY 1), m AS (SELECT id, min(id) OVER (PARTITION BY l) AS class, count(*) OVER (PARTITION BY l) AS copies FROM l)
 SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS score FROM v x JOIN v y USING (term) JOIN m p ON p.id = x.id AND p.class = x.id JOIN m q ON q.id = y.id AND q.class = y.id WHERE x.id < y.id OR (x.id = y.id AND p.copies > 1) GROUP BY 1, 2 HAVING round(sum(x.w * y.w), 6) >= 0.15""",
)
def term_links(spark, sf_dir):
    """Conversations whose heaviest terms are alike, a pair of classes each."""
    return L.cosine_links(L.top_term_vectors(_conversation_terms(spark, sf_dir)), 0.15, scaled=True)[0]


@query("term_clusters")
def term_clusters(spark, sf_dir):
    """Clusters of conversations by label propagation over their links; the tests hold them against a plain version."""
    return L.term_clusters(_conversation_terms(spark, sf_dir))


@query(
    "centroid_scores",
    f"""WITH {_TERMS}, c AS (SELECT doc_id AS id, term, count(*) AS tf FROM t GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) <= 20),
 g AS (SELECT id, feature, sum(tf) AS tf FROM (SELECT id, unnest(CASE WHEN length(term) <= 2 THEN ['_' || term || '_'] ELSE list_transform(range(1, length(term) + 0), lambda i: ('_' || term || '_')[i:i + 3]) END) AS feature, tf FROM c) GROUP BY 1, 2),
 f AS (SELECT id, 'word' AS channel, term AS feature, tf FROM c UNION ALL SELECT id, 'gram', feature, tf FROM g),
 d AS (SELECT channel, feature, count(*) AS df FROM f GROUP BY 1, 2), k AS (SELECT count(DISTINCT id) AS n FROM c),
 r AS (SELECT id, channel, feature, (1 + ln(tf)) * (ln((1 + (SELECT n FROM k)) / (1 + df)) + 1) AS w FROM f JOIN d USING (channel, feature)),
 v AS (SELECT id, channel, feature, w / sqrt(sum(w * w) OVER (PARTITION BY id, channel)) AS w FROM r),
 p AS (SELECT source, channel, feature, sum(w) AS p FROM v JOIN documents ON doc_id = id GROUP BY 1, 2, 3),
 o AS (SELECT id, source, channel, feature, p - coalesce(v.w, 0) AS p, v.w FROM (SELECT DISTINCT id, source FROM v JOIN documents ON doc_id = id) JOIN p USING (source) LEFT JOIN v USING (id, channel, feature)),
 s AS (SELECT id, channel, CASE WHEN sum(p * p) <= 1e-9 THEN 0 ELSE greatest(0, sum(p * w) / sqrt(sum(p * p))) END AS c FROM o GROUP BY 1, 2)
 SELECT id, round(coalesce(max(c) FILTER (channel = 'word'), 0), 6) AS word, round(coalesce(max(c) FILTER (channel = 'gram'), 0), 6) AS gram FROM s GROUP BY 1""",
)
def centroid_scores(spark, sf_dir):
    """Documents against what is left of their source without them; the twin sums each rest anew."""
    terms = K.top_terms(_terms(spark, sf_dir), "doc_id", 20).select(F.col("doc_id").alias("id"), "term", "tf")
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group"), F.lit(1.0).alias("weight"))
    return M.group_scores(M.unit_vectors(terms), own, own_only=True).select("id", "word", "gram")
