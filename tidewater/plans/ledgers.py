"""Queries of logs, queues, caches, scans, registries, imports and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater import extension as X
from tidewater.plans.registry import query, table
from tidewater.sources import units as U
from tidewater.streaming import upkeep as M


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("bus_routes", "SELECT 'all' AS subscriber, count(*) AS n FROM events UNION ALL SELECT 'buys', count(*) FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'p', count(*) FROM events WHERE starts_with(event_type, 'p')")
def bus_routes(spark, sf_dir):
    seen = []
    bus = M.Bus()
    for name, pattern in (("all", "*"), ("buys", "purchase"), ("p", "p*")):
        bus.subscribe(pattern, lambda df, n, name=name: seen.append(df.select(F.lit(name).alias("subscriber")).groupBy("subscriber").agg(F.count("*").alias("n"))))
    bus.publish(_events(spark, sf_dir), kind="event_type")
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query("log_append", "SELECT 1000000 + row_number() OVER (ORDER BY ts, event_id) AS seq, event_id FROM events WHERE event_type <> 'view'")
def log_append(spark, sf_dir):
    """Events that the log lacks, numbered on in order of time."""
    e = _events(spark, sf_dir).select("ts", "event_id", "event_type")
    log = e.where("event_type = 'view'").select(F.lit(1_000_000).cast("long").alias("seq"), "ts", "event_id", "event_type")
    return M.appended(log, e, "event_id", "ts", "event_id").select("seq", "event_id")


@query("log_cursor", "SELECT event_id AS seq, event_type FROM events WHERE event_id > 700 AND starts_with(event_type, 'p') ORDER BY seq LIMIT 50")
def log_cursor(spark, sf_dir):
    log = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), "event_type")
    return M.after(log, 700, 50, "p*", "event_type")


@query("resumed_scan", "SELECT doc_id::VARCHAR AS path, CASE WHEN lang = 'de' THEN md5(text || '!') ELSE md5(text) END AS fingerprint FROM documents WHERE lang IN ('de', 'fr')")
def resumed_scan(spark, sf_dir):
    """Unfinished and changed inputs are scanned again."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("fingerprint"), (F.col("lang") != "fr").alias("finished"), "lang", "text")
    now = d.select("path", F.when(F.col("lang") == "de", F.md5(F.concat("text", F.lit("!")))).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return M.to_scan(now, d)


@query(
    "task_cache",
    """WITH t AS (SELECT event_type AS kind, md5((event_id % 40)::VARCHAR) AS input_hash, min(event_id) AS task, count(*) AS submissions FROM events GROUP BY 1, 2),
 k AS (SELECT event_type AS kind, md5((event_id % 40)::VARCHAR) AS input_hash, max((value > 95)::INT) AS d, max((value BETWEEN 90 AND 95)::INT) AS o FROM events WHERE event_id % 40 < 30 GROUP BY 1, 2)
 SELECT t.*, CASE WHEN d IS NULL THEN 'new' WHEN d = 1 THEN 'cached' WHEN o = 1 THEN 'joined' ELSE 'retry' END AS verdict FROM t LEFT JOIN k USING (kind, input_hash)""",
)
def task_cache(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("kind"), F.md5((F.col("event_id") % 40).cast("string")).alias("input_hash"), F.col("event_id").alias("task"), "value")
    status = F.when(F.col("value") > 95, "done").when(F.col("value").between(90, 95), "pending").otherwise("failed")
    return M.submitted(e, e.where(F.col("task") % 40 < 30).select("kind", "input_hash", status.alias("status")))


@query("recovered_tasks", "SELECT event_id, CASE WHEN event_type = 'error' AND value >= 50 THEN 'paused' WHEN value >= 50 THEN 'pending' ELSE 'done' END AS status FROM events")
def recovered_tasks(spark, sf_dir):
    status = F.when(F.col("value") >= 75, "executing").when(F.col("value") >= 50, "pending").otherwise("done")
    return M.recovered(_events(spark, sf_dir).select("event_id", F.col("event_type").alias("kind"), status.alias("status")), ["error"]).select("event_id", "status")


@query("sequence_tails", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def sequence_tails(spark, sf_dir):
    """Tails of the first half of the log, brought up to date by the second."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type")
    half = e.agg(F.floor(F.max("event_id") / 2)).first()[0]
    none = e.where("false")
    old = M.tails(none, e.where(F.col("event_id") <= half), "user_id", "event_id", 5)
    return M.tails(old, e.where(F.col("event_id") > half), "user_id", "event_id", 5)


@query(
    "sequence_counts",
    """WITH s AS (SELECT event_id, lag(event_type, 2) OVER w || '>' || lag(event_type) OVER w || '>' || event_type AS signature FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT signature, count(*) AS n FROM s WHERE signature IS NOT NULL AND event_id > (SELECT max(event_id) // 2 FROM events) GROUP BY 1""",
)
def sequence_counts(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type")
    half = e.agg(F.floor(F.max("event_id") / 2)).first()[0]
    return M.sequence_counts(e, "user_id", "event_id", "event_type", 3, e.where(F.col("event_id") > half))


@query("leased_queue")
def leased_queue(spark, sf_dir):
    """Leases with fencing tokens, replayed per task; the tests hold them against a plain state machine."""
    op = F.element_at(F.array(*[F.lit(x) for x in ("claim", "begin", "renew", "complete", "mark_unknown", "reconcile")]), (F.col("event_id") * 7 % 6 + 1).cast("int"))
    rows = _events(spark, sf_dir).select((F.col("user_id") % 50).alias("task"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("owner"), (F.col("event_id") % 3).alias("token"), F.col("event_id").alias("at"), F.lit(400).cast("long").alias("seconds"))
    return M.leases(rows)


@query(
    "unit_extraction",
    """WITH p AS (SELECT doc_id, string_split(text || chr(10) || '```' || source || '```' || lang, '```') AS p FROM documents),
 x AS (SELECT doc_id, array_to_string(list_filter(p, lambda y, i: i % 2 = 1), chr(10)) AS prose, array_to_string(list_filter(p, lambda y, i: i % 2 = 0), chr(10)) AS code, len(p) // 2 AS blocks FROM p)
 SELECT doc_id, md5(prose) AS prose, code, blocks::BIGINT AS blocks, length(prose) AS prose_chars, length(code) AS code_chars, substr(prose, 1, 200) AS head FROM x""",
)
def unit_extraction(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n```"), "source", F.lit("```"), "lang").alias("text"))
    return U.extracted(d, "doc_id", "text").withColumn("prose", F.md5("prose"))


_UNITS = "u AS (SELECT source AS platform, (doc_id // 40)::VARCHAR AS ext_id, doc_id AS created, md5(text) AS digest, lang FROM documents)"


@query(
    "catalogue_scan",
    f"""WITH {_UNITS}, b AS (SELECT platform, ext_id, created, digest, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS n FROM u), c AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY n, created, platform, ext_id) > 1 AS copy FROM b),
 k AS (SELECT *, lag(digest) OVER w AS previous, row_number() OVER w AS v FROM c WHERE NOT copy WINDOW w AS (PARTITION BY platform, ext_id ORDER BY n, created, digest))
 SELECT platform, ext_id, created, digest, CASE WHEN previous IS NULL THEN 'new' ELSE 'version' END AS state, previous, v::INTEGER AS version_num FROM k WHERE n = 1 UNION ALL SELECT platform, ext_id, created, digest, 'duplicate', NULL, NULL FROM c WHERE copy AND n = 1""",
)
def catalogue_scan(spark, sf_dir):
    """Units of other languages against a catalogue of the English ones."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("platform"), F.floor(F.col("doc_id") / 40).cast("string").alias("ext_id"), F.col("doc_id").alias("created"), F.md5("text").alias("digest"), "lang")
    return U.scan(d.where("lang <> 'en'").drop("lang"), d.where("lang = 'en'").drop("lang"))


@query("source_registry", "SELECT source AS name, CASE WHEN source < 'src2' THEN 'known' ELSE 'found' END AS origin, CASE WHEN source < 'src2' THEN 0 ELSE min(doc_id) END AS first FROM documents GROUP BY 1")
def source_registry(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    known = d.where("source < 'src2'").select(F.col("source").alias("name"), F.lit("known").alias("origin"), F.lit(0).cast("long").alias("first")).distinct()
    return U.registered(known, d.select(F.col("source").alias("name"), F.lit("found").alias("origin"), F.col("doc_id").alias("first")), "name", "first")


@query(
    "import_plan",
    """WITH s AS (SELECT * FROM events WHERE event_id < 20), r AS (SELECT event_id, 0 AS k FROM s UNION ALL SELECT event_id, 1 FROM events WHERE user_id IN (SELECT user_id FROM s)
  UNION ALL SELECT e.event_id, 2 FROM events e WHERE EXISTS (SELECT 1 FROM s WHERE abs(epoch_us(s.ts) // 1000000 - epoch_us(e.ts) // 1000000) <= 3600))
 SELECT event_id, ['selected', 'sibling', 'window'][min(k) + 1] AS reason FROM r GROUP BY 1""",
)
def import_plan(spark, sf_dir):
    e = _events(spark, sf_dir)
    return U.import_plan(e, e.where("event_id < 20"), "event_id", "user_id", "ts", 3600)


@query(
    "sync_status",
    """WITH b AS (SELECT p_partkey AS path, p_name AS t FROM part WHERE p_size <> 7), h AS (SELECT p_partkey AS path, CASE WHEN p_size % 5 = 0 THEN p_name || '!' ELSE p_name END AS t FROM part WHERE p_size <> 8), t AS (SELECT p_partkey AS path, CASE WHEN p_size % 3 = 0 THEN p_name || '?' ELSE p_name END AS t FROM part WHERE p_size <> 9),
 j AS (SELECT coalesce(b.path, h.path, t.path) AS path, b.t AS b, h.t AS h, t.t AS t FROM b FULL JOIN h ON b.path = h.path FULL JOIN t ON t.path = coalesce(b.path, h.path))
 SELECT path::VARCHAR AS path, CASE WHEN h IS NOT DISTINCT FROM t THEN 'same' WHEN b IS NOT DISTINCT FROM t THEN CASE WHEN h IS NULL THEN 'delete there' ELSE 'push' END WHEN b IS NOT DISTINCT FROM h THEN CASE WHEN t IS NULL THEN 'delete here' ELSE 'pull' END ELSE 'conflict' END AS state FROM j""",
)
def sync_status(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    side = lambda cond, body: p.where(cond).select(F.col("p_partkey").cast("string").alias("path"), U.blob_sha(F.encode(body, "UTF-8")).alias("sha"))
    name, mark = F.col("p_name"), lambda n, m: F.when(F.col("p_size") % n == 0, F.concat("p_name", F.lit(m))).otherwise(F.col("p_name"))
    return U.sync_status(side("p_size <> 7", name), side("p_size <> 8", mark(5, "!")), side("p_size <> 9", mark(3, "?")))


@query(
    "dossiers",
    """WITH f AS (SELECT s_nationkey AS k, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
 l AS (SELECT k, max(n) AS n, string_agg('- ' || s_name, chr(10) ORDER BY r) AS lines FROM f WHERE r <= 3 GROUP BY 1)
 SELECT n_nationkey AS k, '# ' || n_name || coalesce(chr(10) || chr(10) || lines || CASE WHEN n > 3 THEN chr(10) || '- and ' || (n - 3) || ' more' ELSE '' END, '') AS markdown FROM nation LEFT JOIN l ON k = n_nationkey""",
)
def dossiers(spark, sf_dir):
    subjects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return U.dossiers(subjects, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_name"), "k", "n_name", "s_name", "s_name", 3)


@query("rule_verdicts", "SELECT p_partkey, CASE WHEN p_size = 10 THEN 'pending' WHEN p_retailprice / (p_size - 10) > 20 AND length(p_name) >= 5 THEN 'holds' ELSE 'violated' END AS verdict FROM part")
def rule_verdicts(spark, sf_dir):
    """A rule of the closed set of operations; what can't be divided isn't known."""
    rule = ["all", ["gt", ["div", ["field", "p_retailprice"], ["sub", ["field", "p_size"], ["const", 10]]], 20.0], ["ge", ["length", ["field", "p_name"]], 5]]
    return table(spark, sf_dir, "part").select("p_partkey", X.verdict(rule).alias("verdict"))


@query("mean_vectors", "SELECT label, round(avg(embedding[1]), 6) AS first, round(avg(embedding[64]), 6) AS last FROM embeddings GROUP BY 1")
def mean_vectors(spark, sf_dir):
    rows = X.mean_vector(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rows.select("label", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round(F.element_at("centroid", 64), 6).alias("last"))


@query("sql_functions", "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents")
def sql_functions(spark, sf_dir):
    X.register_sql(spark)
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "token_estimate(text) AS tokens")


@query("analysis_mode", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]{4}'))::INTEGER AS analysis FROM documents")
def analysis_mode(spark, sf_dir):
    registry = X.Registry()
    registry.add("mode", "years", lambda c: F.regexp_count(c, F.lit("[0-9]{4}")))
    return X.analysed(table(spark, sf_dir, "documents").select("doc_id", "text"), registry, "years").drop("text")


@query("segment_words", r"SELECT item_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS words FROM benchmark")
def segment_words(spark, sf_dir):
    """A table function joined laterally."""
    spark.udtf.register("segments", X.Segments)
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("_benchmark")
    return spark.sql("SELECT item_id, count(*) AS words FROM _benchmark, LATERAL segments(text) GROUP BY item_id")
