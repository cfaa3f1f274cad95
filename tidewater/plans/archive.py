"""Queries of the archive, catalogue, text-function and relational families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import text as fx
from tidewater.operators import archive as A
from tidewater.plans.registry import query, table


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


@query(
    "conversation_export",
    "SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown, count(*) AS messages FROM conversations GROUP BY 1",
)
def conversation_export(spark, sf_dir):
    return A.export_markdown(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(
    "mask_filter",
    """WITH m AS (SELECT doc_id, concat_ws(',', CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END, CASE WHEN n_chars < 500 THEN 'too short' END, CASE WHEN n_chars > 5000 THEN 'too long' END, CASE WHEN source = 'src3' THEN 'source' END) AS reasons FROM documents)
 SELECT doc_id, reasons, reasons = '' AS passed FROM m""",
)
def mask_filter(spark, sf_dir):
    masks = {"language": ~F.col("lang").isin("en", "de"), "too short": F.col("n_chars") < 500, "too long": F.col("n_chars") > 5000, "source": F.col("source") == "src3"}
    return A.masked(_t(spark, sf_dir, "documents"), masks).select("doc_id", "reasons", "passed")


@query(
    "rule_match",
    "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars BETWEEN 1000 AND 4000 AND regexp_matches(text, 'license|apache', 'i')",
)
def rule_match(spark, sf_dir):
    rule = {"lang": "en", "chars": (1000, 4000), "pattern": "license|apache"}
    return _t(spark, sf_dir, "documents").where(A.rule(rule)).select("doc_id")


@query("catalogue_query", "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'version') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def catalogue_query(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("version")))
    return rows.orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(20).select("doc_id", "lang", "n_chars")


@query("event_query", "SELECT event_id, event_type FROM events WHERE event_id > 500 AND starts_with(event_type, 'p') AND user_id = 7 ORDER BY event_id LIMIT 100")
def event_query(spark, sf_dir):
    return A.event_page(_t(spark, sf_dir, "events"), 500, "p*", 100, F.col("user_id") == 7).select("event_id", "event_type")


@query(
    "latest_eligible_run",
    "SELECT user_id, max(event_id) AS run FROM events WHERE event_type <> 'error' AND value > 5 GROUP BY 1",
)
def latest_eligible_run(spark, sf_dir):
    return _t(spark, sf_dir, "events").where("event_type <> 'error' and value > 5").groupBy("user_id").agg(F.max("event_id").alias("run"))


@query("computed_column", "SELECT p_partkey, round(coalesce(p_retailprice / nullif(p_size - 10, 0), 0) + greatest(p_size, 5) + length(p_name), 4) AS score FROM part")
def computed_column(spark, sf_dir):
    ratio = F.coalesce(F.try_divide(F.col("p_retailprice"), F.col("p_size") - 10), F.lit(0.0))
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(ratio + F.greatest(F.col("p_size"), F.lit(5)) + F.length("p_name"), 4).alias("score"))


@query(
    "html_text",
    r"""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body, CAST(len(regexp_extract_all(html, '(?i)<a\s')) AS BIGINT) AS links FROM pages""",
)
def html_text(spark, sf_dir):
    return A.html_text(_t(spark, sf_dir, "pages"), "page_id", "html")


@query(
    "url_parts",
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""",
)
def url_parts(spark, sf_dir):
    part = lambda p, name: F.regexp_extract("url", p, 1).alias(name)
    return _t(spark, sf_dir, "pages").select("page_id", part(r"^([a-z]+)://", "scheme"), part("://([^/?#]*)", "host"), part("[?]([^#]*)", "query"), part("#(.*)$", "fragment"))


@query("json_props", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(props ->> '$.missing' AS VARCHAR) AS missing FROM events WHERE CAST(props ->> '$.k' AS BIGINT) > 90")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, sf_dir, "events").where(k > 90).select("event_id", k.alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


_ENTITIES = {"date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "email": r"[A-Za-z0-9.+_-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "version": r"\b[vV]ersion ([0-9.]+[0-9])", "licence": r"\b(Apache|MIT|GPL|BSD)\b"}


@query(
    "entities_regex",
    "SELECT DISTINCT doc_id, kind, lower(value) AS value FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', {int('(' in p)})) AS value FROM documents" for k, p in _ENTITIES.items())
    + ")",
)
def entities_regex(spark, sf_dir):
    return A.entities(_t(spark, sf_dir, "documents"), _ENTITIES, "doc_id", "text")


_TOPICS = {"licensing": ["license", "apache", "copyright", "version"], "contact": ["@", "mail", "phone"], "function": ["the", "and", "with"]}


@query(
    "topics",
    "SELECT doc_id, topic FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS topic, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws) + " AS n FROM documents" for k, ws in _TOPICS.items()) + ") WHERE n >= 2",
)
def topics(spark, sf_dir):
    return A.topics(_t(spark, sf_dir, "documents"), _TOPICS, 2, "doc_id", "text")


@query(
    "relations_regex",
    r"""SELECT doc_id, unnest(regexp_extract_all(text, '(\w+) under the (\w+)', 1)) AS subject, unnest(regexp_extract_all(text, '(\w+) under the (\w+)', 2)) AS object FROM documents""",
)
def relations_regex(spark, sf_dir):
    return A.relations(_t(spark, sf_dir, "documents"), r"(\w+) under the (\w+)", "doc_id", "text")


_STOPS = {"en": ["the", "and", "of", "to", "in", "that", "is"], "de": ["der", "die", "und", "das", "ist", "nicht", "mit"], "fr": ["le", "la", "les", "et", "des", "est", "que"], "es": ["el", "los", "las", "de", "un", "por", "para"]}


@query(
    "language_guess",
    "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents), s AS (SELECT doc_id, "
    + ", ".join(f"len(list_filter(t, lambda x: list_contains({ws}, x))) AS {k}" for k, ws in _STOPS.items())
    + " FROM t) SELECT doc_id, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'unknown' "
    + " ".join(f"WHEN {k} = greatest(en, de, fr, es) THEN '{k}'" for k in _STOPS)
    + " END AS language FROM s",
)
def language_guess(spark, sf_dir):
    return A.language_by_stops(_t(spark, sf_dir, "documents"), _STOPS, "doc_id", "text")


@query(
    "redaction_masks",
    r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{9,}\b')) AS v, generate_subscripts(regexp_extract_all(text, '\b[0-9]{9,}\b'), 1) AS i FROM documents), d AS (SELECT doc_id, v, min(i) AS i FROM f GROUP BY ALL)
 SELECT doc_id, v AS value, '[NUMBER#' || row_number() OVER (PARTITION BY doc_id ORDER BY i) || ']' AS mask FROM d""",
)
def redaction_masks(spark, sf_dir):
    return A.masks(_t(spark, sf_dir, "documents"), "NUMBER", r"\b[0-9]{9,}\b", "doc_id", "text")


@query("stable_ids", "SELECT doc_id, 'doc-' || substr(sha256(concat_ws(chr(31), source, lang, doc_id::VARCHAR)), 1, 16) AS stable_id FROM documents")
def stable_ids(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", A.stable_id("doc-", "source", "lang", F.col("doc_id").cast("string")).alias("stable_id"))


@query(
    "trigram_jaccard",
    """WITH n AS (SELECT DISTINCT p_name AS a FROM part), g AS (SELECT a, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substring(a, i, 3))) AS g FROM n)
 SELECT x.a AS a, y.a AS b, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 6) AS jaccard FROM g x JOIN g y ON x.a < y.a AND list_has_any(x.g, y.g)""",
)
def trigram_jaccard(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    return A.trigram_pairs(names, "a")


@query("split_identifier", r"""SELECT o_orderkey, lower(array_to_string(string_split_regex(o_orderpriority, '[- ]+'), '|')) AS parts FROM orders""")
def split_identifier(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.array_join(F.split("o_orderpriority", "[- ]+"), "|")).alias("parts"))


@query(
    "compare_versions",
    """WITH v AS (SELECT p_partkey, p_size || '.' || (p_partkey % 13) || '.' || (p_partkey % 7) AS v FROM part), k AS (SELECT *, list_transform(string_split(v, '.'), lambda x: x::INT) AS k FROM v) SELECT p_partkey, v, k > [25, 6, 3] AS newer FROM k""",
)
def compare_versions(spark, sf_dir):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 13).cast("string"), (F.col("p_partkey") % 7).cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", v.alias("v"), (A.version_key(v) > F.array(F.lit(25), F.lit(6), F.lit(3))).alias("newer"))


@query(
    "transcript_turns",
    r"""WITH t AS (SELECT conv_id, string_agg(role || ': ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1), l AS (SELECT conv_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS i FROM t)
 SELECT conv_id, i::INTEGER AS turn, regexp_extract(line, '^(user|assistant|system): ', 1) AS role, length(regexp_replace(line, '^(user|assistant|system): ', '')) AS chars FROM l""",
)
def transcript_turns(spark, sf_dir):
    return A.transcript(A.export_lines(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"), "conv_id", "body")


@query(
    "column_folding",
    """WITH f AS (SELECT doc_id, replace(replace(replace(translate(lower(text), 'àáâãäåąćçèéêëęìíîïłñńòóôõöśùúûüýÿźż', 'aaaaaaacceeeeeiiiilnnooooosuuuuyyzz'), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae') AS t FROM documents)
 SELECT doc_id, length(t) AS folded, md5(t) AS digest FROM f""",
)
def column_folding(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(fx.fold(F.col("text"))).cast("long").alias("folded"), F.md5(fx.fold(F.col("text"))).alias("digest"))


@query(
    "overlay_compose",
    """WITH o AS (SELECT p_partkey % 100 AS id, p_partkey AS seq, CASE p_partkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'modify' WHEN 2 THEN 'hide' ELSE 'modify' END AS op, p_name AS value FROM part)
 SELECT id, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM o GROUP BY 1 HAVING arg_max(op, seq) <> 'hide'""",
)
def overlay_compose(spark, sf_dir):
    op = F.when(F.col("p_partkey") % 4 == 0, "add").when(F.col("p_partkey") % 4 == 2, "hide").otherwise("modify")
    ops = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("id"), F.col("p_partkey").alias("seq"), op.alias("op"), F.col("p_name").alias("value"))
    return ops.groupBy("id").agg(F.max_by("op", "seq").alias("op"), F.max_by("value", "seq").alias("value")).where("op <> 'hide'")


@query(
    "topic_segments",
    """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{4,}')) AS t FROM conversations), s AS (SELECT conv_id, turn, CASE WHEN lag(t) OVER w IS NULL OR len(list_intersect(t, lag(t) OVER w)) < 2 THEN 1 ELSE 0 END AS b FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 g AS (SELECT conv_id, turn, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM s) SELECT conv_id, segment::BIGINT AS segment, min(turn) AS first, max(turn) AS last FROM g GROUP BY ALL""",
)
def topic_segments(spark, sf_dir):
    return A.segments(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2)


@query("cube_roles", "SELECT role, turn, grouping(role)::BIGINT * 2 + grouping(turn) AS g, count(*) AS n FROM conversations GROUP BY CUBE (role, turn)")
def cube_roles(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").cube("role", "turn").agg(F.grouping_id().cast("long").alias("g"), F.count("*").alias("n"))


@query("rollup_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "ranking_windows",
    """SELECT p_partkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, round(percent_rank() OVER w, 6) AS pct, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS quartile, round(cume_dist() OVER w, 6) AS cume, nth_value(p_size, 2) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""",
)
def ranking_windows(spark, sf_dir):
    w, total = Window.partitionBy("p_brand").orderBy("p_size"), Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    whole = total.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.round(F.percent_rank().over(w), 6).alias("pct"),
        F.ntile(4).over(total).cast("long").alias("quartile"), F.round(F.cume_dist().over(w), 6).alias("cume"), F.nth_value("p_size", 2).over(whole).alias("second"),
    )


@query("semi_anti_joins", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_anti_joins(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    left = c.join(o.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    big = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")).distinct()
    return left.join(big, F.col("k") == F.col("c_custkey"), "left").select("c_custkey", F.col("k").isNotNull().alias("big"))


@query(
    "set_operations",
    """(SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) UNION ALL (SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) UNION ALL
 (SELECT 'except all', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier))""",
)
def set_operations(spark, sf_dir):
    a, b = _t(spark, sf_dir, "customer").select("c_nationkey"), _t(spark, sf_dir, "supplier").select("s_nationkey")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except all": a.exceptAll(b)}
    return reduce(lambda x, y: x.unionByName(y), [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in parts.items()])


@query("full_outer_counts", "SELECT coalesce(c_nationkey, s_nationkey) AS k, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def full_outer_counts(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("c"))
    s = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("s"))
    return c.join(s, "k", "full_outer")


@query("pivot_statuses", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_statuses(spark, sf_dir):
    wide = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "FOP"])


_Q1 = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""


@query("pricing_summary", _Q1)
def pricing_summary(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz '1998-09-02 00:00:00'"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


@query(
    "shipping_priority",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
def shipping_priority(spark, sf_dir):
    c, o, li = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    o = o.where(F.col("o_orderdate") < F.expr("timestamp_ntz '1995-03-15 00:00:00'"))
    joined = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("l_orderkey", "o_orderpriority").agg(revenue.alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderpriority")


@query(
    "truth_tables",
    """WITH b AS (SELECT i, i % 2 = 1 AS p, i // 2 % 2 = 1 AS q, i // 4 % 2 = 1 AS r FROM range(8) t(i)) SELECT i, (NOT p OR q) AND (NOT q OR r) AS premises, NOT p OR r AS conclusion FROM b""",
)
def truth_tables(spark, sf_dir):
    bit = lambda k: F.shiftright("i", k).bitwiseAND(F.lit(1)) == 1
    p, q, r = bit(0), bit(1), bit(2)
    return spark.range(8).withColumnRenamed("id", "i").select("i", ((~p | q) & (~q | r)).alias("premises"), (~p | r).alias("conclusion"))


@query(
    "layout_recognition",
    """WITH r(layout, pattern, weight) AS (VALUES ('list', '(?m)^- ', 1.0), ('table', '[|]', 1.5), ('prose', '[.] [A-Z]', 1.2), ('unknown', '', 0.4)), s AS (SELECT doc_id, layout, sum(CASE WHEN regexp_matches(text, pattern) THEN weight ELSE 0 END)::DOUBLE AS s FROM documents CROSS JOIN r GROUP BY ALL),
 x AS (SELECT doc_id, layout, exp(s) / sum(exp(s)) OVER (PARTITION BY doc_id) AS share FROM s) SELECT doc_id, arg_max(layout, (share, layout)) AS layout, round(max(share), 6) AS share FROM x GROUP BY 1""",
)
def layout_recognition(spark, sf_dir):
    rules = [("list", "(?m)^- ", 1.0), ("table", "[|]", 1.5), ("prose", "[.] [A-Z]", 1.2), ("unknown", "", 0.4)]
    return A.recognise(_t(spark, sf_dir, "documents"), rules, "doc_id", "text")


@query(
    "money_format",
    """SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN '0' WHEN o_totalprice >= 100000 THEN printf('%.0fk', floor(o_totalprice / 1000)) ELSE printf('%.2f', o_totalprice) END AS shown FROM orders""",
)
def money_format(spark, sf_dir):
    p = F.col("o_totalprice")
    shown = F.when(p == 0, "0").when(p >= 100_000, F.format_string("%.0fk", F.floor(p / 1000).cast("double"))).otherwise(F.format_string("%.2f", p))
    return _t(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))


@query("glob_match", "SELECT page_id, regexp_matches(regexp_extract(url, '://(.*)$', 1), '^[^/]*[.]example[.]com/.*[.]html$') AS hit FROM pages")
def glob_match(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", A.glob(F.regexp_extract("url", "://(.*)$", 1), "*.example.com/**.html").alias("hit"))


