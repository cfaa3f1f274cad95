"""Queries of the maintenance and evidence families: queues, compaction, cleanup, annotations, resolution, support."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import archive as A
from tidewater.operators import upkeep as U
from tidewater.plans.registry import query, table


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


@query("task_claim", "SELECT user_id, min(event_id) AS task FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1")
def task_claim(spark, sf_dir):
    """First pending task with a handler, per worker pool, first in first out."""
    return _t(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "view")).groupBy("user_id").agg(F.min("event_id").alias("task"))


@query(
    "usage_compaction",
    """WITH c AS (SELECT max(ts) - INTERVAL 10 DAY AS cut FROM events), f AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, 'folded' AS state, count(*) AS n, round(sum(value), 2) AS total FROM events CROSS JOIN c WHERE ts < cut AND event_type IN ('purchase', 'error') GROUP BY ALL)
 SELECT * FROM f UNION ALL SELECT user_id, strftime(ts, '%Y-%m-%d'), 'open', 1, round(value, 2) FROM events CROSS JOIN c WHERE NOT (ts < cut AND event_type IN ('purchase', 'error'))""",
)
def usage_compaction(spark, sf_dir):
    """Terminal rows older than ten days are folded per user and day; the others stay."""
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = F.broadcast(e.agg((F.max("ts") - F.expr("interval 10 days")).alias("cut")))
    old = (F.col("ts") < F.col("cut")) & F.col("event_type").isin("purchase", "error")
    rows, day = e.join(cut), F.date_format("ts", "yyyy-MM-dd").alias("day")
    folded = rows.where(old).groupBy("user_id", day).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).withColumn("state", F.lit("folded"))
    return folded.unionByName(rows.where(~old).select("user_id", day, F.lit(1).cast("long").alias("n"), F.round("value", 2).alias("total"), F.lit("open").alias("state")))


@query("orphan_blobs", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def orphan_blobs(spark, sf_dir):
    """Stored things that nothing refers to."""
    used = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return _t(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


@query(
    "annotation_conflicts",
    """WITH a AS (SELECT o_orderkey AS id, o_custkey AS message, o_orderpriority AS category, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS by_user, round(o_totalprice / 500000, 2) AS confidence FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY message, category ORDER BY by_user DESC, confidence DESC, id DESC) AS r, count(*) OVER (PARTITION BY message, category) AS n FROM a)
 SELECT id, CASE WHEN n = 1 THEN 'single' WHEN r = 1 THEN 'kept' ELSE 'lost' END AS state FROM r""",
)
def annotation_conflicts(spark, sf_dir):
    """User over confidence over newest."""
    by_user = F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    a = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("message"), F.col("o_orderpriority").alias("category"), by_user.alias("u"), F.round(F.col("o_totalprice") / 500000, 2).alias("c"))
    w = Window.partitionBy("message", "category")
    rank = F.row_number().over(w.orderBy(F.desc("u"), F.desc("c"), F.desc("id")))
    state = F.when(F.count("*").over(w) == 1, "single").when(rank == 1, "kept").otherwise("lost")
    return a.select("id", state.alias("state"))


@query(
    "import_policies",
    """WITH prior AS (SELECT md5(text) AS h, min(doc_id) AS prior FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT doc_id, md5(text) AS h, lang FROM documents WHERE doc_id % 2 = 1)
 SELECT doc_id, CASE WHEN prior IS NULL THEN 'import' WHEN lang = 'en' THEN 'reuse_prior' ELSE 'reimport_and_link' END AS action, prior FROM n LEFT JOIN prior USING (h)""",
)
def import_policies(spark, sf_dir):
    """What an import does with content it has seen."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("h"))
    prior = d.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("prior"))
    action = F.when(F.col("prior").isNull(), "import").when(F.col("lang") == "en", "reuse_prior").otherwise("reimport_and_link")
    return d.where("doc_id % 2 = 1").join(prior, "h", "left").select("doc_id", action.alias("action"), "prior")


@query(
    "counter_evidence",
    """WITH a AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT l_suppkey AS s, l_orderkey AS o FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.1)
 SELECT s AS claim, o AS counter FROM a JOIN c USING (s) GROUP BY ALL""",
)
def counter_evidence(spark, sf_dir):
    """Anchors and exactly one hop of recorded counter links."""
    li = _t(spark, sf_dir, "lineitem")
    anchors = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("claim")).distinct()
    counters = li.where("l_returnflag = 'A' and l_discount >= 0.1").select(F.col("l_suppkey").alias("claim"), F.col("l_orderkey").alias("counter")).distinct()
    return anchors.join(counters, "claim")


@query(
    "evidence_overlap",
    """WITH o AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment || floor(c_acctbal / 50)::BIGINT AS o FROM customer), n AS (SELECT k, count(*) AS n FROM o GROUP BY 1),
 s AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM o a JOIN o b USING (o) WHERE a.k < b.k GROUP BY 1, 2)
 SELECT s.*, x.n - shared AS only_a, y.n - shared AS only_b FROM s JOIN n x ON x.k = a JOIN n y ON y.k = b""",
)
def evidence_overlap(spark, sf_dir):
    """Shared and separate observations of claims that share any, through an index of observations."""
    seen = F.concat("c_mktsegment", F.floor(F.col("c_acctbal") / 50).cast("string"))
    o = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), seen.alias("o")).distinct()
    n = o.groupBy("k").agg(F.count("*").alias("n"))
    shared = o.withColumnRenamed("k", "a").join(o.withColumnRenamed("k", "b"), "o").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    x, y = (n.select(F.col("k").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    return shared.join(x, "a").join(y, "b").select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"))


@query(
    "text_levels",
    r"""SELECT doc_id, length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS without_marks, length(regexp_replace(regexp_replace(text, '[#*$%&|<>]+', '', 'g'), '[0-9]{4,}', '', 'g')) AS without_numbers, sha256(text) AS source_hash FROM documents""",
)
def text_levels(spark, sf_dir):
    """Lossy levels of a text, each with the hash of the source it was made from."""
    marks = F.regexp_replace("text", "[#*$%&|<>]+", "")
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(marks).cast("long").alias("without_marks"), F.length(F.regexp_replace(marks, "[0-9]{4,}", "")).cast("long").alias("without_numbers"), F.sha2("text", 256).alias("source_hash"))


@query("status_history", "SELECT o_custkey, string_agg(o_orderstatus, '>' ORDER BY o_orderdate, o_orderkey) AS history, count(*) AS n FROM orders GROUP BY 1")
def status_history(spark, sf_dir):
    listed = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("h"))
    return listed.select("o_custkey", F.array_join(F.transform("h", lambda x: x["o_orderstatus"]), ">").alias("history"), F.size("h").cast("long").alias("n"))


@query(
    "principle_support",
    """WITH s AS (SELECT p_type AS principle, l_suppkey AS unit, strftime(l_shipdate, '%Y-%m') AS day, max(l_discount) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
 SELECT principle, count(DISTINCT unit) AS units, count(DISTINCT day) AS days, round(1 - (1 - avg(c)) * pow(0.7, least(count(DISTINCT unit), 40)), 6) AS confidence FROM s GROUP BY 1 HAVING count(DISTINCT unit) >= 3 AND count(DISTINCT day) >= 2""",
)
def principle_support(spark, sf_dir):
    """Statements with support from enough units and dates; confidence rises with each unit."""
    j = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s = j.groupBy(F.col("p_type").alias("principle"), F.col("l_suppkey").alias("unit"), F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM").alias("day")).agg(F.max("l_discount").alias("c"))
    g = s.groupBy("principle").agg(F.count_distinct("unit").alias("units"), F.count_distinct("day").alias("days"), F.avg("c").alias("c")).where("units >= 3 and days >= 2")
    return g.select("principle", "units", "days", F.round(1 - (1 - F.col("c")) * F.pow(F.lit(0.7), F.least("units", F.lit(40))), 6).alias("confidence"))


@query(
    "entity_resolution_pairs",
    """WITH p AS (SELECT p_partkey AS id, p_name, p_type, p_brand || '|' || split_part(p_name, ' ', 1) AS block FROM part)
 SELECT a.id AS a, b.id AS b, round(0.5 * (a.p_name = b.p_name)::INT + 0.3 * (a.p_type = b.p_type)::INT + 0.2, 6)::DOUBLE AS score FROM p a JOIN p b USING (block) WHERE a.id < b.id AND 0.5 * (a.p_name = b.p_name)::INT + 0.3 * (a.p_type = b.p_type)::INT + 0.2 >= 0.6
 ORDER BY score DESC, a, b""",
)
def entity_resolution_pairs(spark, sf_dir):
    """Pairs of a block that score 0.6 or more, best first."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", F.concat_ws("|", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1))).alias("block"))
    return U.resolution_pairs(p, "id", "block", "p_name", "p_type", 0.6)


@query(
    "first_dates",
    r"""SELECT o_orderkey, regexp_extract('on ' || strftime(o_orderdate, '%Y-%m-%d') || ' it', '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS day, epoch(o_orderdate)::BIGINT AS seconds FROM orders""",
)
def first_dates(spark, sf_dir):
    text = F.concat(F.lit("on "), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.lit(" it"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract(text, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("day"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("seconds"))


def _halving_sql() -> str:
    """Steps of a search for the longest equal beginning of columns a and b."""
    steps = ""
    for k in range(20):
        steps += f" k{k + 1} AS (SELECT doc_id, a, b, k + CASE WHEN k + {1 << (19 - k)} <= least(length(a), length(b)) AND substr(a, k + 1, {1 << (19 - k)}) = substr(b, k + 1, {1 << (19 - k)}) THEN {1 << (19 - k)} ELSE 0 END AS k FROM k{k}),\n"
    return steps.rstrip(",\n")


@query(
    "shared_prefixes",
    f"""WITH f AS (SELECT source, lang, arg_min(text, doc_id) AS b FROM documents GROUP BY 1, 2), k0 AS (SELECT doc_id, text AS a, b, 0 AS k FROM documents JOIN f USING (source, lang)),
{_halving_sql()} SELECT doc_id, k::BIGINT AS shared FROM k20""",
)
def shared_prefixes(spark, sf_dir):
    """Length of the prefix each version shares with the first of its group."""
    return U.shared_prefixes(_t(spark, sf_dir, "documents"), ["source", "lang"], "doc_id", "text")


@query("changed_lines")
def changed_lines(spark, sf_dir):
    """Lines added and removed between consecutive messages of a role in a conversation."""
    m = _t(spark, sf_dir, "conversations")
    pairs = m.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))).where("before is not null")
    return U.changed_lines(pairs, ["conv_id", "turn"], "before", "text")


@query(
    "budget_skip",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
 s AS (SELECT conv_id, turn, cost, r, cost <= 400 AS kept, CASE WHEN cost <= 400 THEN 400 - cost ELSE 400 END AS rest FROM c WHERE r = 1
  UNION ALL SELECT c.conv_id, c.turn, c.cost, c.r, c.cost <= rest, CASE WHEN c.cost <= rest THEN rest - c.cost ELSE rest END FROM s JOIN c ON c.conv_id = s.conv_id AND c.r = s.r + 1)
 SELECT conv_id, turn, cost FROM s WHERE kept""",
)
def budget_skip(spark, sf_dir):
    """Skip policy: messages newest first that still fit the conversation's budget."""
    costs = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4.0).cast("long").alias("cost"))
    return U.within_skipping(costs, "conv_id", F.desc("turn"), "cost", 400).select("conv_id", "turn", "cost")


@query("stable_claim_ids", "SELECT l_orderkey, l_linenumber, 'clm-' || substr(sha256(concat_ws(chr(31), l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_returnflag)), 1, 16) AS claim_id FROM lineitem")
def stable_claim_ids(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", A.stable_id("clm-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag").alias("claim_id"))
