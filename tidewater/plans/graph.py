"""Queries of the graph family. Node numbers: regions from 0, nations from 100, customers from 1,000, suppliers from
10,000,000, orders from 100,000,000; parts are numbered by their own key where they are the only nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import graph as G
from tidewater.plans.registry import query, table
from tidewater.workspace import materialize

_LINKS_SQL = """links AS (SELECT 100 + n_nationkey::BIGINT AS source, n_regionkey::BIGINT AS target, 'part_of' AS kind FROM nation
 UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, 'lives_in' FROM customer UNION ALL SELECT 10000000 + s_suppkey, 100 + s_nationkey, 'based_in' FROM supplier
 UNION ALL SELECT 100000000 + o_orderkey, 1000 + o_custkey, 'ordered_by' FROM orders)"""


def links(spark, sf_dir):
    """The foreign keys as typed links."""
    one = lambda name, a, key, b, to, kind: table(spark, sf_dir, name).select((F.lit(a) + F.col(key)).cast("long").alias("source"), (F.lit(b) + F.col(to)).cast("long").alias("target"), F.lit(kind).alias("kind"))
    return (
        one("nation", 100, "n_nationkey", 0, "n_regionkey", "part_of")
        .unionByName(one("customer", 1000, "c_custkey", 100, "c_nationkey", "lives_in"))
        .unionByName(one("supplier", 10_000_000, "s_suppkey", 100, "s_nationkey", "based_in"))
        .unionByName(one("orders", 100_000_000, "o_orderkey", 1000, "o_custkey", "ordered_by"))
    )


@query("graph_edges", f"WITH {_LINKS_SQL} SELECT source, target, kind FROM links WHERE kind <> 'ordered_by'")
def graph_edges(spark, sf_dir):
    return links(spark, sf_dir).where("kind <> 'ordered_by'")


@query("link_type_histogram", f"WITH {_LINKS_SQL} SELECT l.kind, count(*) AS n, coalesce(class, 'unclassified') AS class FROM links l LEFT JOIN (VALUES ('part_of', 'hierarchy'), ('lives_in', 'place')) c(kind, class) USING (kind) GROUP BY ALL")
def link_type_histogram(spark, sf_dir):
    known = F.broadcast(spark.createDataFrame([("part_of", "hierarchy"), ("lives_in", "place")], "kind string, class string"))
    counted = links(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return counted.join(known, "kind", "left").select("kind", "n", F.coalesce("class", F.lit("unclassified")).alias("class"))


@query("node_degrees", f"WITH {_LINKS_SQL} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM links UNION ALL SELECT target FROM links) GROUP BY 1 HAVING count(*) > 20")
def node_degrees(spark, sf_dir):
    return links(spark, sf_dir).select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).where("degree > 20")


@query("incident_links", f"WITH {_LINKS_SQL} SELECT source, target, kind FROM links WHERE source = 105 OR target = 105")
def incident_links(spark, sf_dir):
    every = links(spark, sf_dir)
    return every.where("source = 105").unionByName(every.where("target = 105 and source <> 105"))


@query(
    "bfs_depth",
    f"""WITH RECURSIVE {_LINKS_SQL}, e AS (SELECT source AS a, target AS b FROM links WHERE kind <> 'ordered_by' UNION SELECT target, source FROM links WHERE kind <> 'ordered_by'),
 r(node, depth) AS (SELECT 105::BIGINT, 0 UNION SELECT b, depth + 1 FROM r JOIN e ON node = a WHERE depth < 3 AND b <> 2)
 SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY 1""",
)
def bfs_depth(spark, sf_dir):
    both = G.undirected(links(spark, sf_dir).where("kind <> 'ordered_by'").select("source", "target"))
    return G.bfs(both, spark.createDataFrame([(105,)], "node long"), 3, spark.createDataFrame([(2,)], "node long"))


@query(
    "hierarchy_closure",
    """WITH RECURSIVE e AS (SELECT p_partkey AS c, p_partkey // 3 AS p FROM part WHERE p_partkey // 3 <> p_partkey), r(node, ancestor, distance) AS (SELECT c, p, 1 FROM e UNION ALL SELECT node, p, distance + 1 FROM r JOIN e ON ancestor = c WHERE distance < 16)
 SELECT node, ancestor, min(distance)::INTEGER AS distance FROM r WHERE node <> ancestor GROUP BY ALL""",
)
def hierarchy_closure(spark, sf_dir):
    edges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c"), F.floor(F.col("p_partkey") / 3).alias("p"))
    return G.closure(edges, "c", "p")


_COPURCHASE = "SELECT DISTINCT a.l_suppkey AS source, b.l_suppkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey AND a.l_quantity >= 48 AND b.l_quantity >= 48"


def _copurchase(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select("l_orderkey", "l_suppkey")
    pairs = big.withColumnRenamed("l_suppkey", "source").join(big.withColumnRenamed("l_suppkey", "target"), "l_orderkey")
    return pairs.where("source < target").select("source", "target").distinct()


@query(
    "components",
    f"""WITH RECURSIVE l AS ({_COPURCHASE}), e AS (SELECT source AS a, target AS b FROM l UNION SELECT target, source FROM l), r(node, c) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT b, c FROM r JOIN e ON node = a)
 SELECT node, min(c) AS component FROM r GROUP BY 1""",
)
def components(spark, sf_dir):
    return G.components(_copurchase(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")))


@query("label_propagation")
def label_propagation(spark, sf_dir):
    return G.label_propagation(_copurchase(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")), 5)


@query(
    "wl_fingerprint",
    f"""WITH {_LINKS_SQL}, l AS (SELECT * FROM links WHERE kind <> 'ordered_by'), n AS (SELECT DISTINCT node FROM (SELECT source AS node FROM l UNION ALL SELECT target FROM l)),
 c0 AS (SELECT node, CASE WHEN node < 100 THEN 'region' WHEN node < 1000 THEN 'nation' WHEN node < 10000000 THEN 'customer' ELSE 'supplier' END AS colour FROM n),
 c1 AS (SELECT c0.node, substr(sha256(any_value(c0.colour) || '|' || coalesce(string_agg(d.colour, ',' ORDER BY d.colour), '')), 1, 16) AS colour FROM c0 LEFT JOIN l ON source = c0.node LEFT JOIN c0 d ON d.node = target GROUP BY 1),
 c2 AS (SELECT c1.node, substr(sha256(any_value(c1.colour) || '|' || coalesce(string_agg(d.colour, ',' ORDER BY d.colour), '')), 1, 16) AS colour FROM c1 LEFT JOIN l ON source = c1.node LEFT JOIN c1 d ON d.node = target GROUP BY 1)
 SELECT colour, count(*) AS nodes FROM c2 GROUP BY 1""",
)
def wl_fingerprint(spark, sf_dir):
    every = links(spark, sf_dir).where("kind <> 'ordered_by'").select("source", "target")
    kind = F.when(F.col("node") < 100, "region").when(F.col("node") < 1000, "nation").when(F.col("node") < 10_000_000, "customer").otherwise("supplier")
    nodes = every.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("colour", kind)
    return G.wl_fingerprint(every, nodes, 2).groupBy("colour").agg(F.count("*").alias("nodes"))


@query(
    "pattern_join",
    """SELECT DISTINCT o.o_orderkey AS o, c.c_custkey AS c, n.n_nationkey AS n, s.s_suppkey AS s FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN supplier s ON s_nationkey = n_nationkey JOIN lineitem l ON l_orderkey = o_orderkey AND l_suppkey = s_suppkey""",
)
def pattern_join(spark, sf_dir):
    t = lambda name, *cols: table(spark, sf_dir, name).select(*cols).distinct()
    return G.pattern([
        (t("orders", "o_orderkey", "o_custkey"), "o", "c"), (t("customer", "c_custkey", "c_nationkey"), "c", "n"),
        (t("lineitem", "l_orderkey", "l_suppkey"), "o", "s"), (t("supplier", "s_suppkey", "s_nationkey"), "s", "n"),
    ]).select("o", "c", "n", "s").distinct()


@query(
    "upsert_links",
    """WITH o AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS f FROM orders)
 SELECT o_custkey, o_orderstatus, arg_max(o_orderkey, (f, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (f, o_orderkey)) AS o_totalprice FROM o GROUP BY ALL""",
)
def upsert_links(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return G.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query(
    "tree_paths",
    """WITH RECURSIVE e AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey - 1 - p_partkey % 3 % 2 END AS p FROM part), k AS (SELECT n, CASE WHEN p >= 0 AND p // 10 = n // 10 THEN p END AS p FROM e),
 r(n, path) AS (SELECT n, [n] FROM k WHERE p IS NULL UNION ALL SELECT k.n, list_append(r.path, k.n) FROM k JOIN r ON k.p = r.n) SELECT n, len(path)::INTEGER AS depth, array_to_string(path, '/') AS path FROM r""",
)
def tree_paths(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"))
    up = F.when(F.col("n") % 10 != 0, F.col("n") - 1 - F.col("n") % 3 % 2)
    nodes = part.withColumn("p", F.when(F.floor(up / 10) == F.floor(F.col("n") / 10), up))
    return G.tree_paths(nodes, "n", "p").select("n", F.size("path").alias("depth"), F.array_join("path", "/").alias("path"))


_TRADE_LINKS = "SELECT DISTINCT s_nationkey AS s, c_nationkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey AND o_orderdate < TIMESTAMP '1995-01-01'"


@query(
    "path_proof",
    f"""WITH RECURSIVE k AS ({_TRADE_LINKS}), z AS (SELECT min(s) AS a, max(t) AS b FROM k),
 r(path, node) AS (SELECT [s, t], t FROM k WHERE s = (SELECT a FROM z) UNION ALL SELECT list_append(path, t), t FROM r JOIN k ON node = s WHERE NOT list_contains(path, t) AND len(path) < 4) SELECT array_to_string(path, '>') AS path FROM r WHERE node = (SELECT b FROM z)""",
)
def path_proof(spark, sf_dir):
    """Every simple path of at most three deliveries between two nations, by what was known at the beginning of 1995."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    known = o.where("o_orderdate < timestamp_ntz '1995-01-01'").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = li.select("l_orderkey", "l_suppkey").join(known, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    links = materialize(sold.select(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).distinct().where("source <> target"))
    ends = links.agg(F.min("source").alias("a"), F.max("target").alias("b")).first()
    return G.simple_paths(links, F.col("source") == ends.a, F.col("node") == ends.b, 3).select(F.array_join("path", ">").alias("path"))


@query(
    "scope_resolution",
    """WITH v AS (SELECT c_custkey AS k, 1 AS r, 'global' AS level, 'g' AS value FROM customer UNION ALL SELECT c_custkey, 2, 'segment', CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END FROM customer UNION ALL SELECT c_custkey, 3, 'customer', CASE WHEN c_acctbal < 0 THEN 'hold' END FROM customer)
 SELECT k, arg_max(value, r) AS value, arg_max(level, r) AS level FROM v WHERE value IS NOT NULL GROUP BY 1""",
)
def scope_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    at = lambda level, value: c.select(F.col("c_custkey").alias("k"), F.lit(level).alias("level"), value.alias("value"))
    values = at("global", F.lit("g")).unionByName(at("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))).unionByName(at("customer", F.when(F.col("c_acctbal") < 0, "hold")))
    return G.scope(values, "k", "level", ["global", "segment", "customer"], "value")


@query(
    "action_fit",
    """WITH a(action, needs) AS (VALUES ('restock', ['1-URGENT', '5-LOW']), ('audit', ['2-HIGH']), ('close', ['1-URGENT', '2-HIGH', '3-MEDIUM'])), t AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS traits FROM orders GROUP BY 1)
 SELECT k, action, len(list_filter(needs, lambda x: NOT list_contains(traits, x))) = 0 AS fits, array_to_string(list_sort(list_filter(needs, lambda x: NOT list_contains(traits, x))), ',') AS missing FROM t CROSS JOIN a""",
)
def action_fit(spark, sf_dir):
    traits = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("traits"))
    actions = spark.createDataFrame([("restock", ["1-URGENT", "5-LOW"]), ("audit", ["2-HIGH"]), ("close", ["1-URGENT", "2-HIGH", "3-MEDIUM"])], "action string, needs array<string>")
    missing = F.sort_array(F.array_except("needs", "traits"))
    return traits.join(F.broadcast(actions)).select("k", "action", (F.size(missing) == 0).alias("fits"), F.array_join(missing, ",").alias("missing"))


@query("dangling_references", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN (SELECT p_partkey AS l_partkey FROM part WHERE p_size <> 50) USING (l_partkey)")
def dangling_references(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size <> 50").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "transfer_pairs",
    """WITH r AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), x AS (SELECT a.s AS a, b.s AS b, count(*) AS roles FROM r a JOIN r b ON a.p = b.p AND a.s < b.s GROUP BY ALL HAVING count(*) >= 2)
 SELECT x.a, x.b, roles, count(t.p) AS transferable FROM x LEFT JOIN r t ON t.s = x.a AND NOT EXISTS (SELECT 1 FROM r f WHERE f.s = x.b AND f.p = t.p) GROUP BY ALL""",
)
def transfer_pairs(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    pairs = r.withColumnRenamed("s", "a").join(r.withColumnRenamed("s", "b"), "p").where("a < b").groupBy("a", "b").agg(F.count("*").alias("roles")).where("roles >= 2")
    filled = r.groupBy("s").agg(F.count("*").alias("n"))
    return pairs.join(filled.withColumnRenamed("s", "a"), "a").select("a", "b", "roles", (F.col("n") - F.col("roles")).alias("transferable"))


@query(
    "provenance_gaps",
    """SELECT l_orderkey AS run, count(*) AS outputs FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus <> 'P') USING (l_orderkey) GROUP BY 1""",
)
def provenance_gaps(spark, sf_dir):
    recorded = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(recorded, "l_orderkey", "left_anti").groupBy(F.col("l_orderkey").alias("run")).agg(F.count("*").alias("outputs"))
