"""Queries of further measures and message operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import measures as Q
from tidewater.operators import messages as M
from tidewater.operators import timeline as T
from tidewater.plans.registry import query, table
from tidewater.sources import units as U


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


_GROUPS = "g AS (SELECT md5(text) AS digest, count(*) AS n, (sum(n_chars) - max(n_chars))::BIGINT AS redundant, array_to_string(list_sort(list(doc_id))[1:2], ',') AS examples FROM documents GROUP BY 1 HAVING count(*) > 1)"


@query("duplicate_examples", f"WITH {_GROUPS} SELECT * FROM g")
def duplicate_examples(spark, sf_dir):
    return Q.duplicate_examples(_docs(spark, sf_dir), F.md5("text"), "doc_id", F.col("n_chars"), 2)


@query("top_findings", f"WITH {_GROUPS} SELECT *, (SELECT count(*) FROM g) AS all_groups, (SELECT sum(redundant)::BIGINT FROM g) AS all_redundant FROM g ORDER BY redundant DESC, digest LIMIT 5")
def top_findings(spark, sf_dir):
    return Q.findings(duplicate_examples(spark, sf_dir), 5)


@query(
    "message_diff",
    """WITH b AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN turn + 1 ELSE turn END AS turn, CASE WHEN role = 'user' AND length(text) % 2 = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE conv_id % 7 <> 0), a AS (SELECT * FROM conversations WHERE conv_id % 11 <> 0),
 j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.text AS x, b.text AS y FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn),
 c AS (SELECT conv_id, count(*) FILTER (x IS NULL) AS added, count(*) FILTER (y IS NULL) AS removed, count(*) FILTER (x <> y) AS changed, count(*) FILTER (x = y) AS kept, count(*) AS n FROM j GROUP BY 1)
 SELECT conv_id, added, removed, changed, kept, CASE WHEN added = n THEN 'new' WHEN removed = n THEN 'removed' WHEN kept = n THEN 'unchanged' ELSE 'changed' END AS state FROM c""",
)
def message_diff(spark, sf_dir):
    """Two states of the conversations: some only in one, some moved by a place, some with other texts."""
    c = table(spark, sf_dir, "conversations")
    turn = F.when(F.col("conv_id") % 5 == 0, F.col("turn") + 1).otherwise(F.col("turn"))
    text = F.when((F.col("role") == "user") & (F.length("text") % 2 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = c.where("conv_id % 7 <> 0").select("conv_id", turn.alias("turn"), F.md5(text).alias("d"))
    return Q.message_diff(c.where("conv_id % 11 <> 0").select("conv_id", "turn", F.md5("text").alias("d")), new, "conv_id", "turn", "d")


@query(
    "skyline_dominators",
    """WITH p AS (SELECT p_brand, p_size, round(-p_retailprice, 2) AS cheap, p_partkey % 10 AS stock, min(p_partkey) AS id FROM part GROUP BY ALL),
 f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.p_brand = p.p_brand AND o.p_size >= p.p_size AND o.cheap >= p.cheap AND o.stock >= p.stock AND (o.p_size > p.p_size OR o.cheap > p.cheap OR o.stock > p.stock))),
 b AS (SELECT p.p_brand, p.p_size, p.cheap, p.stock, count(*) AS n, array_to_string(list_sort(list(f.id))[1:3], ',') AS by_ids FROM p JOIN f ON f.p_brand = p.p_brand AND f.p_size >= p.p_size AND f.cheap >= p.cheap AND f.stock >= p.stock AND (f.p_size > p.p_size OR f.cheap > p.cheap OR f.stock > p.stock) GROUP BY ALL)
 SELECT t.p_brand, t.p_partkey, t.p_size, round(-t.p_retailprice, 2) AS cheap, t.p_partkey % 10 AS stock, coalesce(n, 0) AS dominators, coalesce(by_ids, '') AS "by" FROM part t LEFT JOIN b ON b.p_brand = t.p_brand AND b.p_size = t.p_size AND b.cheap = round(-t.p_retailprice, 2) AND b.stock = t.p_partkey % 10""",
)
def skyline_dominators(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.round(-F.col("p_retailprice"), 2).alias("cheap"), (F.col("p_partkey") % 10).alias("stock"))
    return Q.dominators(p, "p_brand", "p_partkey", ["p_size", "cheap", "stock"])


@query(
    "selective_metrics",
    """WITH s AS (SELECT lang, quality, n_chars / 4000.0 AS score FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (quality = 0 AND score >= 0.5) AS fp, count(*) FILTER (quality = 0 AND score <= 0.2) AS tn, count(*) FILTER (quality = 1 AND score <= 0.2) AS fn, count(*) AS planned FROM s GROUP BY 1)
 SELECT lang, tp, fp, tn, fn, round((tp + fp + tn + fn) / planned, 6) AS coverage, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy FROM c""",
)
def selective_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir), "doc_id").select("lang", "quality", (F.col("n_chars") / 4000.0).alias("score"))
    return Q.selective(rows, "quality", "score", 0.2, 0.5, "lang")


@query("family_bootstrap")
def family_bootstrap(spark, sf_dir):
    """The interval brackets the mean; the tests check that."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("family"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return Q.family_bootstrap(rows, "family", "a", "b", 200)


_VERDICTS = "v AS (SELECT doc_id, CASE quality WHEN 1 THEN 'include' ELSE 'exclude' END AS verdict FROM labels)"


@query(
    "correction_proposals",
    rf"""WITH {_VERDICTS}, t AS (SELECT DISTINCT doc_id, verdict, unnest(regexp_extract_all(lower(text), '\p{{N}}*\p{{L}}[\p{{L}}\p{{N}}+#]*')) AS term FROM v JOIN documents USING (doc_id)),
 c AS (SELECT term, count(*) FILTER (verdict = 'include') AS i, count(*) FILTER (verdict = 'exclude') AS e FROM t GROUP BY 1)
 SELECT term, CASE WHEN i >= 3 THEN 'include' ELSE 'exclude' END AS proposal, greatest(i, e) AS corrections FROM c WHERE (i >= 3 AND e = 0) OR (e >= 3 AND i = 0)""",
)
def correction_proposals(spark, sf_dir):
    v = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("verdict"))
    terms = v.join(_docs(spark, sf_dir), "doc_id").select("doc_id", "verdict", F.explode(S.word_tokens(F.col("text"))).alias("term"))
    return Q.proposals(terms, "doc_id", "verdict", 3)


@query("band_moves", f"WITH {_VERDICTS} SELECT min(n_chars) FILTER (verdict = 'include') AS include_from, max(n_chars) FILTER (verdict = 'exclude') AS exclude_to FROM v JOIN documents USING (doc_id)")
def band_moves(spark, sf_dir):
    v = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("verdict"))
    return Q.band_moves(v.join(_docs(spark, sf_dir), "doc_id"), "n_chars", "verdict")


@query(
    "chat_text_turns",
    """WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'system' END AS role, trim(regexp_replace(text, '[\\s:]+', ' ', 'g')) AS text FROM conversations)
 SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS turn, role, text FROM c WHERE text <> ''""",
)
def chat_text_turns(spark, sf_dir):
    """Conversations written with three kinds of labels and read again."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.trim(F.regexp_replace("text", r"[\s:]+", " "))).where("text <> ''")
    label = F.when(F.col("role") == "user", "**You:** ").when(F.col("role") == "assistant", "## Assistant\n").otherwise("System: ")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat(label, "text").alias("l")))), lambda m: m["l"]), "\n")
    return M.chat_turns(c.groupBy("conv_id").agg(body.alias("chat")), "conv_id", "chat")


@query(
    "unit_masks",
    """WITH u AS (SELECT doc_id, lang, source, n_chars, split_part(text, chr(10), 1) AS title, contains(text, '```') AS code FROM documents)
 SELECT doc_id, concat_ws(',', CASE WHEN lang NOT IN ('en', 'de') THEN 'languages' END, CASE WHEN source IN ('src3') THEN 'not_sources' END, CASE WHEN n_chars < 500 THEN 'least_chars' END, CASE WHEN n_chars > 9000 THEN 'most_chars' END,
 CASE WHEN TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 30)::INTEGER) < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 14 HOUR THEN 'created_from' END, CASE WHEN regexp_matches(title, 'license', 'i') THEN 'title_lacks' END, CASE WHEN code THEN 'code' END) AS reasons FROM u""",
)
def unit_masks(spark, sf_dir):
    created = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(doc_id % 30)")
    units = _docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.contains("text", F.lit("```")).alias("has_code"), created.alias("created"))
    masks = M.unit_masks({"languages": ["en", "de"], "not_sources": ["src3"], "least_chars": 500, "most_chars": 9000, "created_from": "2024-01-05 00:00:00", "title_lacks": "license", "code": False})
    from tidewater.operators import archive as A

    return A.masked(units, masks).select("doc_id", "reasons")


@query(
    "interleaved_blocks",
    """WITH e AS (SELECT user_id, event_id, event_type, epoch(ts) AS t FROM events), c AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 20000 THEN 0 ELSE 1 END AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 b AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY t, event_id) AS block FROM c), r AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id, block ORDER BY t, event_id) = event_type THEN 0 ELSE 1 END AS y FROM b),
 s AS (SELECT *, sum(y) OVER (PARTITION BY user_id, block ORDER BY t, event_id) AS run FROM r), g AS (SELECT user_id, block, run, event_type, count(*) AS n FROM s GROUP BY ALL),
 k AS (SELECT *, coalesce(lag(event_type) OVER o = lead(event_type) OVER o, false) AS sw, count(*) OVER (PARTITION BY user_id, block, event_type) AS k FROM g WINDOW o AS (PARTITION BY user_id, block ORDER BY run)),
 m AS (SELECT *, k >= 2 OR bool_or(sw) OVER (PARTITION BY user_id, block, event_type) AS m FROM k), z AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id, block ORDER BY run) <> event_type THEN 1 ELSE 0 END AS ch FROM m WHERE m)
 SELECT user_id, block::BIGINT AS block, sum(n)::BIGINT AS events, count(*) AS runs, count(DISTINCT event_type) AS members, sum(ch)::BIGINT AS switches FROM z GROUP BY 1, 2 HAVING sum(ch) > 2""",
)
def interleaved_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", T.seconds("ts"))
    return M.interleaved_blocks(e, "user_id", "event_id", "t", "event_type", 20_000, 2)


@query(
    "rare_term_links",
    r"""WITH t AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{N}*\p{L}[\p{L}\p{N}+#]*')) AS term FROM documents), n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM t), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
 r AS (SELECT t.* FROM t JOIN d USING (term) CROSS JOIN n WHERE ln(1 + (n - df + 0.5) / (df + 0.5)) > CASE WHEN n <= 20 THEN 0 ELSE ln(n / 20) END)
 SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS shared, least(1.0, count(*) / 10)::DOUBLE AS strength FROM r a JOIN r b USING (lang, term) WHERE a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 4""",
)
def rare_term_links(spark, sf_dir):
    terms = _docs(spark, sf_dir).select("doc_id", "lang", F.explode(S.word_tokens(F.col("text"))).alias("term"))
    return M.rare_links(terms, "doc_id", "lang", 4)


@query(
    "message_grains",
    """WITH m AS (SELECT conv_id, turn, length(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
 s AS (SELECT DISTINCT conv_id, unnest(list_concat(range(0, greatest(n - 4, 0) + 1, 3), [greatest(n - 4, 0)])) AS s FROM m)
 SELECT conv_id, 'message' AS grain, turn AS first, turn AS last, c AS chars FROM m UNION ALL SELECT conv_id, 'conversation', min(turn), max(turn), sum(c)::BIGINT FROM m GROUP BY 1
 UNION ALL SELECT conv_id, 'window', min(turn), max(turn), sum(c)::BIGINT FROM m JOIN s USING (conv_id) WHERE i >= s AND i < s + 4 GROUP BY conv_id, s""",
)
def message_grains(spark, sf_dir):
    return M.grains(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 4, 3)


@query(
    "checked_redaction",
    r"""WITH t AS (SELECT c_custkey, 'card ' || (4000000000000000 + c_custkey)::VARCHAR || ' or ' || (c_custkey * 37)::VARCHAR || ' of ' || c_name || ' ' || (4000000000000000 + c_custkey)::VARCHAR AS text FROM customer),
 v AS (SELECT c_custkey, text, unnest(list_distinct(regexp_extract_all(text, '\b[0-9]{16}\b'))) AS value FROM t),
 k AS (SELECT c_custkey, value, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN value[i]::INT WHEN value[i]::INT * 2 > 9 THEN value[i]::INT * 2 - 9 ELSE value[i]::INT * 2 END)) % 10 = 0 AS ok FROM v)
 SELECT c_custkey, 'CARD' AS kind, value, '[CARD#1]' AS mask FROM k WHERE ok UNION ALL SELECT c_custkey, 'NAME', 'Customer', '[NAME#1]' FROM t WHERE contains(text, 'Customer')""",
)
def checked_redaction(spark, sf_dir):
    number = (F.lit(4_000_000_000_000_000) + F.col("c_custkey")).cast("string")
    text = F.concat(F.lit("card "), number, F.lit(" or "), (F.col("c_custkey") * 37).cast("string"), F.lit(" of "), "c_name", F.lit(" "), number)
    docs = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return M.checked_masks(docs, "c_custkey", "text", [("CARD", r"\b[0-9]{16}\b", M.luhn)], {"Customer": "NAME"})


@query("bigram_stats", r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) AS i FROM documents), b AS (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS term FROM w) SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df FROM b WHERE term IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def bigram_stats(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    pairs = _docs(spark, sf_dir).select("doc_id", words.alias("w")).select("doc_id", F.explode(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).alias("term"))
    return pairs.groupBy("term").agg(F.count("*").alias("total"), F.countDistinct("doc_id").alias("df")).where("df >= 3")


@query("tree_budget", "WITH t AS (SELECT p_brand, p_partkey, lpad((p_partkey // 10)::VARCHAR, 8, '0') || '/' || lpad(p_partkey::VARCHAR, 8, '0') AS path, length(p_name) AS cost FROM part), s AS (SELECT *, (sum(cost) OVER (PARTITION BY p_brand ORDER BY path))::BIGINT AS spent FROM t) SELECT p_brand, p_partkey, spent FROM s WHERE spent <= 300")
def tree_budget(spark, sf_dir):
    """Nodes in depth-first order while their characters fit."""
    pad = lambda c: F.lpad(c.cast("string"), 8, "0")
    t = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws("/", pad(F.floor(F.col("p_partkey") / 10)), pad(F.col("p_partkey"))).alias("path"), F.length("p_name").alias("cost"))
    from pyspark.sql import Window

    spent = F.sum("cost").over(Window.partitionBy("p_brand").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    return T.tree_budget(t, "p_brand", "path", "cost", 300).select("p_brand", "p_partkey", "path", "cost").withColumn("spent", spent).select("p_brand", "p_partkey", "spent")


@query("blob_round_trip", "SELECT doc_id, sha256(text) AS digest, length(text) AS chars FROM documents")
def blob_round_trip(spark, sf_dir):
    """Texts put into a store by content, and read again by reference with their digests checked."""
    d = _docs(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    store = U.put_blobs(d, "content")
    return U.get_blobs(d.select("doc_id", F.sha2("content", 256).alias("digest")), store).select("doc_id", "digest", F.length(F.decode("content", "UTF-8")).cast("long").alias("chars"))
