"""Queries of message trees, addresses, plans, graph upkeep, views, patterns and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import addresses as A
from tidewater.operators import graph as G
from tidewater.operators import patterns as X
from tidewater.operators import trees as T
from tidewater.plans.registry import query, table


def _forked(spark, sf_dir):
    """Conversations as trees: each message answers the one before, every third one the one two before."""
    c = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") == 0, None).when((F.col("turn") % 3 == 2) & (F.col("turn") >= 2), F.col("turn") - 2).otherwise(F.col("turn") - 1)
    return c.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), (F.col("conv_id") * 1000 + parent).alias("parent"), F.col("turn").alias("created"), (F.col("role") == "user").alias("marked"))


_FORKED = """m AS (SELECT conv_id, conv_id * 1000 + turn AS msg_id, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 2 THEN conv_id * 1000 + turn - 2 ELSE conv_id * 1000 + turn - 1 END AS parent, turn AS created, role = 'user' AS marked FROM conversations),
 p AS (SELECT conv_id, msg_id, [msg_id] AS path FROM m WHERE parent IS NULL OR parent NOT IN (SELECT msg_id FROM m) UNION ALL SELECT m.conv_id, m.msg_id, list_append(path, m.msg_id) FROM p JOIN m ON m.parent = p.msg_id),
 l AS (SELECT p.*, created, marked FROM p JOIN m USING (msg_id) WHERE p.msg_id NOT IN (SELECT parent FROM m WHERE parent IS NOT NULL))"""
_PLACES = "SELECT conv_id, msg_id AS branch, (generate_subscripts(path, 1) - 1)::INTEGER AS place, unnest(path) AS node"
_ORDERS = {"newest": "created DESC, msg_id DESC", "marked": "marked DESC, len(path) DESC, msg_id DESC", "longest": "len(path) DESC, msg_id DESC"}


def _branch(policy: str):
    @query(f"branches_{policy}", f"WITH RECURSIVE {_FORKED} {_PLACES} FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY {_ORDERS[policy]}) = 1)")
    def run(spark, sf_dir):
        return T.branches(_forked(spark, sf_dir), "conv_id", "msg_id", "parent", policy, marked="marked")


for _policy in _ORDERS:
    _branch(_policy)


@query("branches_all", f"WITH RECURSIVE {_FORKED} {_PLACES} FROM l")
def branches_all(spark, sf_dir):
    return T.branches(_forked(spark, sf_dir), "conv_id", "msg_id", "parent", "all_paths")


@query(
    "branches_cut",
    f"""WITH RECURSIVE {_FORKED}, k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY len(path) DESC, msg_id DESC) = 1)
 SELECT conv_id, (SELECT count(*) FROM l WHERE l.conv_id = c.conv_id) - 1 AS branches_cut, count(*) - (SELECT max(len(path)) FROM l WHERE l.conv_id = c.conv_id) AS messages_cut FROM m c GROUP BY 1""",
)
def branches_cut(spark, sf_dir):
    m = _forked(spark, sf_dir)
    return T.cut(m, T.branches(m, "conv_id", "msg_id", "parent", "longest"), "conv_id", "msg_id", "parent")


@query(
    "address_resolve",
    """WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 a AS (SELECT o_orderkey AS anchor, o_custkey, n FROM o WHERE p = 1) SELECT anchor, o.o_orderkey FROM a JOIN o USING (o_custkey) WHERE o.p BETWEEN a.n - 2 AND a.n""",
)
def address_resolve(spark, sf_dir):
    """From each customer's first order to the last one and the two before it."""
    o = table(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("anchor"))
    steps, _ = T.parse_address("time:last/time:-2..+0")
    return T.resolve(o, first.select("anchor"), steps, {"time": ("o_custkey", "o_orderdate")}, "o_orderkey")


_PLACED = """o AS (SELECT 'o' || o_orderkey AS node, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'o' || o_orderkey) AS r FROM orders),
 n AS (SELECT n_nationkey, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS before FROM nation),
 c AS (SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1),
 l AS (SELECT o_custkey, node FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY r DESC) = 1),
 x AS (SELECT o.node AS anchor, o.r, l.node FROM o JOIN customer k ON k.c_custkey = o.o_custkey JOIN n ON n.n_nationkey = k.c_nationkey LEFT JOIN c ON c.c_nationkey = n.before LEFT JOIN l ON l.o_custkey = c.c_custkey)"""


def _resolved(spark, sf_dir):
    """From each order to the customer's previous one, then three levels: the nation before, its richest customer, the last order."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    own = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    place = lambda dim, seq, node, at, num, name=None: [F.lit(dim).alias("dim"), seq.alias("seq"), node.alias("node"), at.cast("long").alias("place"), num.alias("num"), (F.lit(None) if name is None else F.col(name)).cast("string").alias("name")]
    order, customer, nation = own("o", "o_orderkey"), own("c", "o_custkey"), own("n", "c_nationkey")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = (
        o.select(*place("message", customer, order, at, F.col("o_totalprice")))
        .unionByName(o.select(*place("program_version", customer, order, at, F.col("o_totalprice"))))
        .unionByName(c.select(*place("program_version", nation, own("c", "c_custkey"), F.col("c_custkey"), F.col("c_acctbal"), "c_name")))
        .unionByName(n.select(*place("program_version", own("r", "n_regionkey"), own("n", "n_nationkey"), F.col("n_nationkey"), F.lit(None).cast("double"), "n_name")))
    )
    return A.resolve(A.ranked(rows), o.select(order.alias("anchor")), A.parse("-1/program_version:-1.max.last"))


@query("address_levels", f"WITH {_PLACED} SELECT anchor, node FROM x WHERE r > 1 AND node IS NOT NULL")
def address_levels(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("anchor", "node")


@query("address_advice", f"WITH {_PLACED} SELECT CASE WHEN r = 1 THEN 0 ELSE 1 END AS step, 'address_outside' AS code, count(*) AS anchors FROM x WHERE r = 1 OR node IS NULL GROUP BY 1")
def address_advice(spark, sf_dir):
    """How many orders each step of that address has an advisory for."""
    return _resolved(spark, sf_dir)[1].groupBy("step", "code").agg(F.count("*").alias("anchors"))


def _actions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    gives = F.pmod(F.col("s_nationkey") + F.col("s_suppkey") % 4 + 1, F.lit(25))
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("needs"), gives.cast("long").alias("gives"), F.abs("s_acctbal").alias("cost"), F.round(F.lit(1.0) / (1 + F.col("s_suppkey") % 5), 6).alias("confidence"))


@query("action_chains")
def action_chains(spark, sf_dir):
    """Plans over a catalogue of suppliers; the tests hold them against a search of all sequences."""
    return T.chains(_actions(spark, sf_dir), F.col("needs") < 12, F.col("gives") >= 12, 3, 25_000.0)


@query("nodes_created", "SELECT n_nationkey::BIGINT AS node, n_name AS label, 'nation' AS kind FROM nation UNION ALL SELECT 24 + row_number() OVER (ORDER BY label, kind), label, kind FROM (SELECT DISTINCT p_brand AS label, 'brand' AS kind FROM part)")
def nodes_created(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_name").alias("label"), F.lit("nation").alias("kind"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.lit("brand").alias("kind"))
    return G.get_or_create(nodes, brands.unionByName(nodes.select("label", "kind")), ["label", "kind"])


def _trade(spark, sf_dir):
    """Nodes and links of regions, nations and customers."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    node = lambda df, key, base, label, kind: df.select((F.col(key) + base).cast("long").alias("node"), F.col(label).alias("label"), F.lit(kind).alias("kind"))
    nodes = node(r, "r_regionkey", 0, "r_name", "region").unionByName(node(n, "n_nationkey", 100, "n_name", "nation")).unionByName(node(c, "c_custkey", 1000, "c_mktsegment", "customer"))
    link = lambda df, a, x, b, y, t: df.select((F.col(a) + x).cast("long").alias("source"), (F.col(b) + y).cast("long").alias("target"), F.lit(t).alias("type"))
    return nodes, link(n, "n_nationkey", 100, "n_regionkey", 0, "part_of").unionByName(link(c, "c_custkey", 1000, "c_nationkey", 100, "lives_in"))


_TRADE = """g AS (SELECT r_regionkey::BIGINT AS node, r_name AS label, 'region' AS kind FROM region UNION ALL SELECT n_nationkey + 100, n_name, 'nation' FROM nation UNION ALL SELECT c_custkey + 1000, c_mktsegment, 'customer' FROM customer),
 e AS (SELECT n_nationkey::BIGINT + 100 AS source, n_regionkey::BIGINT AS target, 'part_of' AS type FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, 'lives_in' FROM customer)"""


@query("nodes_deleted", f"WITH {_TRADE} SELECT source, target, type FROM e WHERE source NOT IN (SELECT node FROM g WHERE label = 'BUILDING') AND target NOT IN (SELECT node FROM g WHERE label = 'BUILDING') AND source <> 101 AND target <> 101")
def nodes_deleted(spark, sf_dir):
    nodes, links = _trade(spark, sf_dir)
    return G.delete_nodes(nodes, links, nodes.where("label = 'BUILDING' or node = 101"))[1]


@query(
    "analysis_ingest",
    """WITH m AS (SELECT conv_id, conv_id * 1000 + turn AS msg, role, length(text) AS n FROM conversations)
 SELECT DISTINCT msg::VARCHAR AS source, 'conv-' || conv_id AS target, 'mentions' AS type FROM m WHERE n % 10 >= 3 UNION SELECT DISTINCT msg::VARCHAR, role, 'tagged_with' FROM m
 UNION SELECT DISTINCT 'conv-' || conv_id, 'conv-' || (conv_id + 1), 'precedes' FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE b.conv_id = a.conv_id AND b.n % 10 >= 3) AND EXISTS (SELECT 1 FROM m b WHERE b.conv_id = a.conv_id + 1 AND b.n % 10 >= 3)
 UNION SELECT DISTINCT msg::VARCHAR, conv_id::VARCHAR, 'part_of' FROM m""",
)
def analysis_ingest(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("message"), "role", F.length("text").alias("n"))
    name = lambda c: F.concat(F.lit("conv-"), c.cast("string"))
    entities = m.select("message", name(F.col("conv_id")).alias("label"), (F.col("n") % 10 / 10).alias("relevance"))
    relations = m.select(name(F.col("conv_id")).alias("subject"), F.lit("precedes").alias("predicate"), name(F.col("conv_id") + 1).alias("object"))
    topics = m.select("message", F.upper("role").alias("topic"))
    return G.ingest(m.withColumnRenamed("conv_id", "conversation"), entities, topics, relations, 0.3, 6)[1]


@query(
    "conversation_graph",
    """WITH c AS (SELECT conv_id, conv_id * 1000 + turn AS id, turn FROM conversations)
 SELECT 'node' AS what, id AS a, NULL::BIGINT AS b, 'message' AS type FROM c UNION ALL SELECT 'edge', id, id - 1, 'reply' FROM c WHERE id - 1 IN (SELECT id FROM c) AND turn > 0 UNION ALL SELECT 'node', -conv_id - 1, NULL, 'conversation' FROM (SELECT DISTINCT conv_id FROM c ORDER BY conv_id LIMIT 200)""",
)
def conversation_graph(spark, sf_dir):
    """Message nodes with reply edges, and at most 200 other nodes."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn")
    row = lambda df, what, a, b, t: df.select(F.lit(what).alias("what"), a.alias("a"), b.cast("long").alias("b"), F.lit(t).alias("type"))
    reply = c.where("turn > 0").join(c.select((F.col("id") + 1).alias("id")), "id", "left_semi")
    other = c.select("conv_id").distinct().orderBy("conv_id").limit(200)
    return row(c, "node", F.col("id"), F.lit(None), "message").unionByName(row(reply, "edge", F.col("id"), F.col("id") - 1, "reply")).unionByName(row(other, "node", -F.col("conv_id") - 1, F.lit(None), "conversation"))


@query(
    "perspective_view",
    f"WITH {_TRADE}, w AS (SELECT 2::BIGINT AS node, 0 AS depth UNION ALL SELECT source, 1 FROM e WHERE type = 'part_of' AND target = 2 UNION ALL SELECT c.source, 2 FROM e c JOIN e n ON c.target = n.source WHERE n.target = 2 AND n.type = 'part_of' AND c.type = 'lives_in') SELECT node, label, kind, depth FROM w JOIN g USING (node) WHERE depth = 0 OR kind IN ('nation', 'customer') ORDER BY depth, node LIMIT 60",
)
def perspective_view(spark, sf_dir):
    nodes, links = _trade(spark, sf_dir)
    seeds = spark.createDataFrame([(2,)], "node long")
    return G.perspective(nodes, links, ["part_of", "lives_in"], "in", 2, seeds, F.col("kind").isin("nation", "customer"), 60).select("node", "label", "kind", "depth")


@query("relation_inverses", f"WITH {_TRADE} SELECT source, target, type FROM e UNION SELECT target, source, 'contains' FROM e WHERE type = 'part_of' UNION SELECT target, source, 'lives_in' FROM e WHERE type = 'lives_in'")
def relation_inverses(spark, sf_dir):
    registry = spark.createDataFrame([("part_of", "contains", False), ("lives_in", None, True)], "type string, inverse string, symmetric boolean")
    return G.with_inverses(_trade(spark, sf_dir)[1], registry)


@query(
    "subgraph_matches",
    """WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey + 1000000 AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), n AS (SELECT s_suppkey AS s, s_nationkey AS k FROM supplier)
 SELECT a.s AS x, a.p AS part, b.s AS y FROM l a JOIN l b ON a.p = b.p JOIN n na ON na.s = a.s JOIN n nb ON nb.s = b.s WHERE a.s <> b.s AND na.k < 13""",
)
def subgraph_matches(spark, sf_dir):
    """Two different suppliers of one part, the first with a label: every injective match."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45")
    links = li.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1_000_000).alias("target"), F.lit("supplies").alias("type")).distinct()
    label = F.when(F.col("s_nationkey") < 13, "near").otherwise("far")
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), label.alias("label")).unionByName(links.select(F.col("target").alias("node"), F.lit("part").alias("label")).distinct())
    return G.isomorphisms(links, nodes, [("x", "part", "supplies"), ("y", "part", "supplies")], {"x": "near", "part": "part"})


@query(
    "motifs",
    f"""WITH {_TRADE}, t AS (SELECT e.source AS node, concat_ws(':', 'out', type, label) AS tie FROM e JOIN g ON g.node = e.target UNION ALL SELECT e.target, concat_ws(':', 'in', type, label) FROM e JOIN g ON g.node = e.source),
 c AS (SELECT node, tie, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT node, string_agg(tie || '*' || n, ' ' ORDER BY tie || '*' || n) AS ties FROM c GROUP BY 1),
 w AS (SELECT node, node % 7 AS part, label || ' | ' || ties AS shape FROM g JOIN s USING (node))
 SELECT shape, count(*) AS occurrences, count(DISTINCT part) AS groups, min(node) AS example FROM w GROUP BY 1 HAVING count(DISTINCT part) >= 2""",
)
def motifs(spark, sf_dir):
    nodes, links = _trade(spark, sf_dir)
    return G.motifs(links, nodes.withColumn("part", F.col("node") % 7), "part", 2)


@query(
    "graph_ranking",
    """WITH f AS (SELECT o_custkey AS host, o_orderpriority || o_orderstatus AS feature, count(*) AS n FROM orders GROUP BY ALL), q(feature, q) AS (VALUES ('1-URGENTF', 2), ('5-LOWO', 1), ('2-HIGHF', 1)),
 h AS (SELECT host, sqrt(sum(n * n)) AS hn FROM f GROUP BY 1), x AS (SELECT host, sum(least(n, q)) AS shared, sum(n * q) AS dot FROM f JOIN q USING (feature) GROUP BY 1)
 SELECT host, round(shared / 4, 6) AS containment, round(dot / hn / sqrt(6), 6) AS cosine FROM x JOIN h USING (host) ORDER BY containment DESC, cosine DESC, host LIMIT 20""",
)
def graph_ranking(spark, sf_dir):
    features = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("host"), F.concat("o_orderpriority", "o_orderstatus").alias("feature")).agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([("1-URGENTF", 2), ("5-LOWO", 1), ("2-HIGHF", 1)], "feature string, n long")
    return G.rank_graphs(features, asked, 20)


@query("louvain_communities")
def louvain_communities(spark, sf_dir):
    """Nations by what they sell each other; the tests hold the modularity against a sequential search."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    sold = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return G.louvain(sold.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.count("*").cast("double").alias("weight")))


@query("graph_catalogue", f"WITH {_TRADE} SELECT kind AS source, node, label, (SELECT count(*) FROM e WHERE target = g.node) AS children FROM g")
def graph_catalogue(spark, sf_dir):
    """Any source as nodes with their number of children."""
    nodes, links = _trade(spark, sf_dir)
    children = links.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("children"))
    return nodes.join(children, "node", "left").select(F.col("kind").alias("source"), "node", "label", F.coalesce("children", F.lit(0).cast("long")).alias("children"))


@query(
    "import_graph",
    "SELECT DISTINCT 'export:' || source AS source, 'file:' || lang AS target, 'part_of' AS type FROM documents UNION ALL SELECT DISTINCT 'doc:' || doc_id, 'export:' || source, 'derived_from' FROM documents",
)
def import_graph(spark, sf_dir):
    """An import as a graph: file, export, conversation."""
    d = table(spark, sf_dir, "documents")
    link = lambda a, x, b, y, t: d.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"), F.lit(t).alias("type")).distinct()
    return link("export:", "source", "file:", "lang", "part_of").unionByName(link("doc:", "doc_id", "export:", "source", "derived_from"))


@query(
    "closure_by_batches",
    """WITH RECURSIVE f AS (SELECT p_partkey AS s, p_partkey // 3 AS t FROM part WHERE p_partkey > 0), c(source, target) AS (SELECT s, t FROM f UNION SELECT source, t FROM c JOIN f ON target = s)
 SELECT source, target, 'part_of' AS type FROM c UNION ALL SELECT target, source, 'has_part' FROM c""",
)
def closure_by_batches(spark, sf_dir):
    """A hierarchy of parts that arrives in three batches, in no order of levels; the twin closes it at once."""
    facts = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 3").alias("target"), F.lit("part_of").alias("type"))
    registry = spark.createDataFrame([("part_of", "has_part", False, True)], "type string, inverse string, symmetric boolean, transitive boolean")
    now = facts.limit(0)
    for k in range(3):
        now = G.extended_closure(now, G.stated_facts(facts.where(F.col("source") % 3 == k), registry))
    return now


@query("recurring_patterns")
def recurring_patterns(spark, sf_dir):
    """Neighbourhoods of radius two among nations, regions and suppliers that recur; the tests hold them against permutations."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    node = lambda df, kind, c, label, owner: df.select(name(kind, c).alias("node"), label.alias("label"), owner.cast("string").alias("owner"))
    rich = F.when(F.col("s_acctbal") > 5000, "large").otherwise("small")
    nodes = node(s, "s", "s_suppkey", rich, F.col("s_nationkey")).unionByName(node(n, "n", "n_nationkey", F.lit("nation"), F.col("n_regionkey"))).unionByName(node(table(spark, sf_dir, "region"), "r", "r_regionkey", F.lit("region"), F.col("r_regionkey")))
    link = lambda df, a, ka, b, kb, t: df.select(name(a, ka).alias("source"), name(b, kb).alias("target"), F.lit(t).alias("type"))
    links = link(s, "s", "s_suppkey", "n", "s_nationkey", "lives_in").unionByName(link(n, "n", "n_nationkey", "r", "n_regionkey", "part_of"))
    return X.recurring(links, nodes, 2, most_nodes=16, group="owner")
