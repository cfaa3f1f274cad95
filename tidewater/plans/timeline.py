"""Queries of the timeline family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import timeline as T
from tidewater.plans.registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


for _unit in ("hour", "day", "week", "month"):

    @query(f"time_buckets_{_unit}", f"SELECT strftime(date_trunc('{_unit}', ts), '%Y-%m-%d %H:%M') AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
    def time_buckets(spark, sf_dir, unit=_unit):
        return T.buckets(_events(spark, sf_dir), unit, "ts", "event_type")


@query(
    "bursts",
    """WITH c AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT event_type, median(n) AS median FROM c GROUP BY 1)
 SELECT event_type, bucket, n, median FROM c JOIN m USING (event_type) WHERE n > 2 * median""",
)
def bursts(spark, sf_dir):
    return T.bursts(T.buckets(_events(spark, sf_dir), "hour", "ts", "event_type"), 2.0, "event_type").select("event_type", "bucket", "n", "median")


@query(
    "gaps",
    """SELECT user_id, event_id, round(t - b, 3) AS pause FROM (SELECT *, epoch_us(ts) / 1e6 AS t, lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE t - b > 86400""",
)
def gaps(spark, sf_dir):
    return T.gaps(_events(spark, sf_dir), "user_id", "ts", "event_id", 86_400)


@query(
    "sessions",
    """WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 3600 THEN 0 ELSE 1 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
 s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM f)
 SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(max(t) - min(t), 3) AS length FROM s GROUP BY ALL""",
)
def sessions(spark, sf_dir):
    return T.sessions(_events(spark, sf_dir), "user_id", "ts", "event_id", 3600)


@query(
    "run_lengths",
    """WITH f AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS f FROM conversations), s AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
 SELECT conv_id, CAST(run AS BIGINT) AS run, role, count(*) AS n FROM s GROUP BY ALL""",
)
def run_lengths(spark, sf_dir):
    return T.runs(_messages(spark, sf_dir), "conv_id", ["turn"], "role")


@query(
    "work_blocks",
    """WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 7200 THEN 0 ELSE 1 END AS f FROM e),
 b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t, event_id) AS block FROM f), s AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id, block ORDER BY t, event_id) THEN 1 ELSE 0 END AS sw FROM b),
 k AS (SELECT user_id, block, event_type, count(*) AS n, sum(sw) AS s FROM s GROUP BY ALL)
 SELECT user_id, CAST(block AS BIGINT) AS block, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS switches, count(*) FILTER (n >= 2) AS members FROM k GROUP BY ALL HAVING sum(s) >= 2""",
)
def work_blocks(spark, sf_dir):
    return T.work_blocks(_events(spark, sf_dir), "user_id", "ts", "event_id", "event_type", 7200, 2)


@query(
    "sliding_windows",
    """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT DISTINCT conv_id, n, unnest(list_append(range(0, greatest(n - 4, 0) + 1, 2), greatest(n - 4, 0))) AS first FROM n)
 SELECT conv_id, first, least(first + 4, n) AS past FROM s""",
)
def sliding_windows(spark, sf_dir):
    return T.message_windows(_messages(spark, sf_dir), "conv_id", "turn", 4, 2)


@query(
    "context_window",
    """WITH h AS (SELECT *, max((length(text) > 1500)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM conversations) SELECT conv_id, turn, role FROM h WHERE near = 1""",
)
def context_window(spark, sf_dir):
    return T.neighbourhood(_messages(spark, sf_dir), "conv_id", "turn", F.length("text") > 1500, 1).select("conv_id", "turn", "role")


@query(
    "page_cursor",
    """WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations), h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS l FROM t WHERE turn < 5),
 k AS (SELECT * FROM h WHERE r <= 3) SELECT conv_id, turn, total, l > 3 AS truncated, min(turn) OVER (PARTITION BY conv_id) AS next_before FROM k""",
)
def page_cursor(spark, sf_dir):
    return T.page(_messages(spark, sf_dir), "conv_id", "turn", 3, before=5).select("conv_id", "turn", "total", "truncated", "next_before")


@query("relative_offset", "SELECT conv_id, turn, lead(role, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations")
def relative_offset(spark, sf_dir):
    return T.relative(_messages(spark, sf_dir), "conv_id", "turn", "role", 2).select("conv_id", "turn", "other")


@query(
    "first_last_words",
    """SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, min(turn) AS min_turn, max(turn) AS max_turn, arg_max(turn, (length(text), -turn)) AS longest_turn FROM conversations GROUP BY 1""",
)
def first_last_words(spark, sf_dir):
    longest = F.max_by("turn", F.struct(F.length("text"), -F.col("turn")))
    return _messages(spark, sf_dir).groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.min("turn").alias("min_turn"), F.max("turn").alias("max_turn"), longest.alias("longest_turn")
    )


@query(
    "place_range",
    """WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
 SELECT conv_id, turn, place, row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS step FROM p WHERE place BETWEEN 2 AND 4""",
)
def place_range(spark, sf_dir):
    return T.place_range(_messages(spark, sf_dir), "conv_id", "turn", 4, 2).select("conv_id", "turn", "place", "step")


@query(
    "hierarchical_levels",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r FROM customer),
 s AS (SELECT c_nationkey, c_mktsegment, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS lvl FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer))
 SELECT c_nationkey, c_mktsegment, c_custkey FROM c JOIN s USING (c_nationkey, c_mktsegment) WHERE lvl = 2 AND r = 1""",
)
def hierarchical_levels(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    second = T.place_range(customers.select("c_nationkey", "c_mktsegment").distinct(), "c_nationkey", "c_mktsegment", 2, 2)
    return customers.join(second, ["c_nationkey", "c_mktsegment"]).groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))


@query(
    "version_chain",
    """WITH v AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS version, count(*) OVER (PARTITION BY source, lang) AS n, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars, doc_id) AS f FROM documents)
 SELECT doc_id, version, CASE WHEN version = n THEN 'active' ELSE 'version' END AS status, f = 1 AS original FROM v""",
)
def version_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.concat_ws("|", "source", "lang").alias("group"), F.md5("text").alias("digest"))
    return T.versions(docs, "group", ["n_chars", "doc_id"], "digest").select("doc_id", "version", "status", "original")


@query("latest_revision", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_revision(spark, sf_dir):
    return T.latest(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("asof_previous", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def asof_previous(spark, sf_dir):
    return T.previous(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "previous")


@query(
    "asof_join",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value AS viewed FROM events WHERE event_type = 'view')
 SELECT event_id, viewed FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_join(spark, sf_dir):
    events = _events(spark, sf_dir)
    viewed = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("viewed"))
    return T.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), viewed, ["user_id"], "ts", "viewed").select("event_id", "viewed")


@query(
    "nearest_key",
    """WITH t AS (SELECT DISTINCT p_brand, 25 AS target FROM part) SELECT p_brand, arg_min(p_partkey, (abs(p_size - target), p_size, p_partkey)) AS p_partkey, CAST(min(abs(p_size - target)) AS INTEGER) AS gap FROM t JOIN part USING (p_brand) GROUP BY 1""",
)
def nearest_key(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    targets = part.select("p_brand").distinct().withColumn("target", F.lit(25))
    return T.nearest(targets, part.select("p_brand", "p_size", "p_partkey"), ["p_brand"], "target", "p_size", "p_partkey").select("p_brand", "p_partkey", "gap")


_T = "epoch_us(ts) / 1e6"


@query(
    "time_band_join",
    f"""WITH e AS (SELECT event_id, user_id, event_type, {_T} AS t FROM events) SELECT a.event_id AS error_id, b.event_id AS purchase_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(a.t - b.t) <= 3600""",
)
def time_band_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), T.seconds("ts").alias("a"))
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), T.seconds("ts").alias("b"))
    return T.band_join(errors, buys, ["user_id"], "a", "b", 3600.0).select("error_id", "purchase_id")


@query(
    "window_expansion",
    f"""WITH e AS (SELECT event_id, user_id, event_type, value, {_T} AS t FROM events) SELECT event_id, event_type FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE a.user_id = b.user_id AND b.value > 200 AND abs(a.t - b.t) <= 7200)""",
)
def window_expansion(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", T.seconds("ts").alias("a"))
    chosen = e.where("value > 200").select("user_id", F.col("a").alias("b"))
    return T.band_join(e, chosen, ["user_id"], "a", "b", 7200.0).select("event_id", "event_type").distinct()


@query(
    "same_session_links",
    f"""WITH e AS (SELECT event_id, user_id, {_T} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
 SELECT a.user_id, a.event_id AS source, b.event_id AS target, round(1 - (b.t - a.t) / 14400, 6) AS strength FROM e a JOIN e b ON a.user_id = b.user_id AND b.r - a.r BETWEEN 1 AND 3 AND b.t - a.t <= 14400""",
)
def same_session_links(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", T.seconds("ts").alias("t"))
    return T.neighbours(e, "user_id", ["t", "event_id"], "event_id", "t", 3, 14_400.0)


@query(
    "continuation_pairs",
    f"""WITH s AS (SELECT user_id, event_type, min({_T}) AS b, max({_T}) AS e, date_trunc('day', ts) AS d FROM events GROUP BY user_id, event_type, d)
 SELECT x.user_id, x.event_type AS before, y.event_type AS after, strftime(x.d, '%Y-%m-%d') AS day, round(1 - (y.b - x.e) / 10800, 6) AS confidence FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type <> y.event_type AND y.b > x.e AND y.b - x.e <= 10800""",
)
def continuation_pairs(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("t", T.seconds("ts"))
    spans = e.groupBy("user_id", "event_type", F.date_format(F.date_trunc("day", F.col("ts").cast("timestamp")), "yyyy-MM-dd").alias("day")).agg(F.min("t").alias("b"), F.max("t").alias("e"))
    left = spans.select("user_id", F.col("event_type").alias("before"), "day", "e")
    right = spans.select("user_id", F.col("event_type").alias("after"), "b")
    pairs = T.band_join(left, right, ["user_id"], "e", "b", 10_800.0).where("before <> after and b > e")
    return pairs.select("user_id", "before", "after", "day", F.round(1 - (F.col("b") - F.col("e")) / 10_800, 6).alias("confidence"))




@query(
    "interval_union",
    f"""WITH v AS (SELECT user_id, {_T} AS s, {_T} + value * 60 AS e FROM events), r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v)
 SELECT user_id, round(sum(greatest(e - greatest(s, coalesce(r, s)), 0)), 3) AS covered FROM r GROUP BY 1""",
)
def interval_union(spark, sf_dir):
    spans = _events(spark, sf_dir).select("user_id", T.seconds("ts").alias("s"), (T.seconds("ts") + F.col("value") * 60).alias("e"))
    return T.covered(spans, "user_id", "s", "e")


@query(
    "overlap_join",
    f"""WITH v AS (SELECT user_id, event_id, event_type, {_T} AS s, {_T} + value * 60 AS e FROM events WHERE event_type IN ('view', 'click'))
 SELECT a.event_id AS view_id, b.event_id AS click_id FROM v a JOIN v b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.s < b.e AND b.s < a.e""",
)
def overlap_join(spark, sf_dir):
    v = _events(spark, sf_dir).select("user_id", "event_id", "event_type", T.seconds("ts").alias("s"), (T.seconds("ts") + F.col("value") * 60).alias("e"))
    a = v.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = v.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return a.join(b, "user_id").where("s1 < e2 and s2 < e1").select("view_id", "click_id")


@query(
    "budget_prefix",
    """WITH c AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost FROM conversations), s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent FROM c)
 SELECT conv_id, turn, cost, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 400""",
)
def budget_prefix(spark, sf_dir):
    costs = _messages(spark, sf_dir).select("conv_id", "turn", F.ceil(F.length("text") / 4.0).cast("long").alias("cost"))
    return T.budget_prefix(costs, "conv_id", [F.desc("turn")], "cost", 400)


@query(
    "spend_windows",
    """WITH m AS (SELECT max(ts) AS now FROM events), p AS (SELECT user_id, value, ts, now FROM events CROSS JOIN m WHERE event_type = 'purchase'),
 s AS (SELECT user_id, round(coalesce(sum(value) FILTER (date_trunc('day', ts) = date_trunc('day', now)), 0), 2) AS today, round(coalesce(sum(value) FILTER (date_trunc('week', ts) = date_trunc('week', now)), 0), 2) AS week,
  round(coalesce(sum(value) FILTER (date_trunc('month', ts) = date_trunc('month', now)), 0), 2) AS month FROM p GROUP BY 1)
 SELECT *, CASE WHEN month > 900 THEN 'deny' WHEN week > 150 THEN 'confirm' WHEN today > 40 THEN 'notify' ELSE 'allow' END AS decision FROM s""",
)
def spend_windows(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    spent = lambda u: F.round(F.coalesce(F.sum(F.when(F.date_trunc(u, "ts") == F.date_trunc(u, "now"), F.col("value"))), F.lit(0.0)), 2)
    s = e.where("event_type = 'purchase'").join(now).groupBy("user_id").agg(spent("day").alias("today"), spent("week").alias("week"), spent("month").alias("month"))
    return s.withColumn("decision", F.when(F.col("month") > 900, "deny").when(F.col("week") > 150, "confirm").when(F.col("today") > 40, "notify").otherwise("allow"))


@query(
    "step_sequences",
    """WITH s AS (SELECT user_id, event_type AS c, lag(event_type, 1) OVER w AS b, lag(event_type, 2) OVER w AS a, ts, lag(ts, 2) OVER w AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT concat_ws('>', a, b, c) AS signature, count(*) AS n FROM s WHERE a IS NOT NULL AND back <= 50 AND epoch_us(ts) - epoch_us(t0) <= 86400000000 GROUP BY 1 HAVING count(*) >= 2""",
)
def step_sequences(spark, sf_dir):
    w, back = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.withColumns({"b": F.lag("event_type", 1).over(w), "a": F.lag("event_type", 2).over(w), "t0": F.lag("ts", 2).over(w), "back": F.row_number().over(back)})
    near = rows.where(F.col("a").isNotNull() & (F.col("back") <= 50) & (F.unix_micros("ts") - F.unix_micros("t0") <= 86_400_000_000))
    return near.groupBy(F.concat_ws(">", "a", "b", "event_type").alias("signature")).agg(F.count("*").alias("n")).where("n >= 2")


@query("decision_context", "SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ',') AS context FROM events QUALIFY context IS NOT NULL")
def decision_context(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, -1)
    rows = _events(spark, sf_dir).withColumn("c", F.collect_list("event_type").over(w))
    return rows.where(F.size("c") > 0).select("event_id", F.array_join("c", ",").alias("context"))


@query("tumbling", "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


@query(
    "sliding",
    """WITH b AS (SELECT time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') AS b, value FROM events), x AS (SELECT b - INTERVAL '3 hours' * k AS s, value FROM b CROSS JOIN (VALUES (0), (1)) t(k))
 SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 2) AS total FROM x GROUP BY 1""",
)
def sliding(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "6 hours", "3 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "total")


@query(
    "session_window",
    """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM f)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_window(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("range_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS day_total FROM events")
def range_frame(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return e.select("event_id", F.round(F.sum("value").over(w), 4).alias("day_total"))
