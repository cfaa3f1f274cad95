"""Property-graph operators over node and link DataFrames.

Iterative operators join a frontier to the links once per round and store each round's result in the shared folder, so
plans stay short and a lost executor costs one round. Bounded depths are bounds on rounds; nothing is collected but counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.workspace import materialize, written


def undirected(links: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """Both directions of every link, each once."""
    back = links.select(F.col(dst).alias(src), F.col(src).alias(dst), *[c for c in links.columns if c not in (src, dst)])
    return links.unionByName(back).distinct()


def bfs(links: DataFrame, seeds: DataFrame, depth: int, blocked: DataFrame | None = None, src: str = "source", dst: str = "target") -> DataFrame:
    """(node, depth): smallest number of steps from a seed, up to ``depth``; blocked nodes are neither entered nor passed."""
    edges = links.select(src, dst)
    if blocked is not None:
        edges = edges.join(blocked.select(F.col("node").alias(dst)), dst, "left_anti")
    frontier = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    rounds = [frontier]  # stored each; together they are what was reached, so nothing is written twice
    for k in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges[src]).select(F.col(dst).alias("node")).distinct()
        frontier = materialize(step.join(reduce(DataFrame.unionByName, rounds), "node", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds)


def closure(edges: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """(node, ancestor, distance) over a hierarchy, cycle-safe. Raises if it goes on beyond ``most`` levels."""
    level = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node <> ancestor").distinct()
    last = materialize(level.withColumn("distance", F.lit(1)))
    rounds = [last]
    up = level.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"))
    for k in range(2, most + 2):
        step = last.join(up, F.col("ancestor") == F.col("_n")).select("node", F.col("_a").alias("ancestor")).where("node <> ancestor").distinct()
        last = materialize(step.join(reduce(DataFrame.unionByName, rounds), ["node", "ancestor"], "left_anti").withColumn("distance", F.lit(k)))
        if last.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        rounds.append(last)
    raise RuntimeError(f"the hierarchy has more than {most} levels")


def components(links: DataFrame, nodes: DataFrame, src: str = "source", dst: str = "target", most: int = 60) -> DataFrame:
    """(node, component): smallest node reachable, by label propagation with pointer jumping."""
    both = materialize(undirected(links.select(src, dst), src, dst))
    labels = materialize(nodes.select("node", F.col("node").alias("component")))
    for _ in range(most):
        near = both.join(labels, both[dst] == labels["node"]).groupBy(F.col(src).alias("node")).agg(F.min("component").alias("c"))
        new = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"))
        hop = new.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        jumped = materialize(new.join(hop, "component", "left").select("node", F.coalesce("_up", "component").alias("component")))
        moved = jumped.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was")
        if moved.isEmpty():
            return jumped
        labels = jumped
    raise RuntimeError("components did not settle")


def label_propagation(links: DataFrame, nodes: DataFrame, rounds: int, src: str = "source", dst: str = "target") -> DataFrame:
    """Synchronous label propagation: the most frequent neighbour label, ties to the smallest; isolated nodes keep theirs."""
    both = materialize(undirected(links.select(src, dst), src, dst))
    labels = nodes.select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        votes = both.join(labels, both[dst] == labels["node"]).groupBy(F.col(src).alias("node"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("label")).alias("low"))).alias("b")).select("node", (-F.col("b.low")).alias("_l"))
        labels = materialize(labels.join(best, "node", "left").select("node", F.coalesce("_l", "label").alias("label")))
    return labels


def wl_fingerprint(links: DataFrame, nodes: DataFrame, rounds: int, src: str = "source", dst: str = "target") -> DataFrame:
    """Weisfeiler-Lehman colours: a node's colour with the sorted colours of its successors, hashed, ``rounds`` times."""
    colours = nodes.select("node", "colour")
    for _ in range(rounds):
        near = links.join(colours, links[dst] == colours["node"]).groupBy(F.col(src).alias("node")).agg(F.sort_array(F.collect_list("colour")).alias("near"))
        whole = F.concat_ws("|", "colour", F.array_join(F.coalesce("near", F.array().cast("array<string>")), ","))
        colours = colours.join(near, "node", "left").select("node", F.substring(F.sha2(whole, 256), 1, 16).alias("colour"))
    return colours


def pattern(edges: list[tuple[DataFrame, str, str]], distinct: list[tuple[str, str]] = ()) -> DataFrame:
    """Conjunctive pattern: each edge is (rows, variable, variable); variables of the same name join, pairs may differ."""
    rows = reduce(lambda a, b: a.join(b, [c for c in b.columns if c in a.columns]), [e.select(F.col(e.columns[0]).alias(x), F.col(e.columns[1]).alias(y)) for e, x, y in edges])
    for x, y in distinct:
        rows = rows.where(F.col(x) != F.col(y))
    return rows


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins per key; old rows rank before new ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("_new", order, *[c for c in rest if c != order])).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def tree_paths(nodes: DataFrame, node: str, parent: str, most: int = 1000) -> DataFrame:
    """Root-to-node paths as arrays; roots have no parent in the table. Raises if a path is longer than ``most``."""
    base = materialize(nodes.select(node, parent))  # as stored columns: derived ones would be inlined round after round
    roots = base.join(base.select(F.col(node).alias("_p")), base[parent] == F.col("_p"), "left_anti")
    level = materialize(roots.select(node, F.array(node).alias("path")))
    out = level
    for _ in range(most):
        down = base.join(level.select(F.col(node).alias("_p"), "path"), base[parent] == F.col("_p")).select(node, F.concat("path", F.array(node)).alias("path"))
        level = materialize(down)
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"a path has more than {most} nodes")


def simple_paths(links: DataFrame, start: Column, end: Column, most: int, src: str = "source", dst: str = "target") -> DataFrame:
    """All simple paths of at most ``most`` links from nodes that meet ``start`` to nodes that meet ``end`` (a condition on ``node``)."""
    paths = links.where(start).select(F.array(src, dst).alias("path"), F.col(dst).alias("_at"))
    out, level = paths, paths
    for _ in range(most - 1):
        level = level.join(links.select(F.col(src).alias("_at"), F.col(dst).alias("_to")), "_at").where(~F.array_contains("path", F.col("_to"))).select(F.concat("path", F.array("_to")).alias("path"), F.col("_to").alias("_at"))
        out = out.unionByName(level)
    return out.withColumnRenamed("_at", "node").where(end).select("path")


def scope(values: DataFrame, key: str, level: str, order: list[str], value: str) -> DataFrame:
    """The value of the most specific level that has one, with that level."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(level))
    return values.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(F.struct(rank.alias("r"), F.col(value).alias("v"), F.col(level).alias("l"))).alias("b")).select(key, F.col("b.v").alias(value), F.col("b.l").alias(level))


def get_or_create(nodes: DataFrame, wanted: DataFrame, keys: list[str], id_col: str = "node") -> DataFrame:
    """The nodes with those wanted that were missing; new ids follow the largest in order of the keys. The order is over the
    missing ones only, so it is dealt by range, counted per partition and offset."""
    missing = materialize(wanted.select(*keys).distinct().join(nodes.select(*keys), keys, "left_anti").orderBy(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    last = nodes.agg(F.coalesce(F.max(id_col), F.lit(0).cast("long"))).first()[0]
    sizes = missing.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    new = missing.join(F.broadcast(before), "_p").withColumn(id_col, F.lit(last) + F.col("_before") + F.col("_m") - F.col("_first") + 1)
    return nodes.select(id_col, *keys).unionByName(new.select(id_col, *keys))


def delete_nodes(nodes: DataFrame, links: DataFrame, gone: DataFrame, src: str = "source", dst: str = "target") -> tuple[DataFrame, DataFrame]:
    """Nodes and links without the given nodes and whatever touches them."""
    ids = gone.select("node").distinct()
    left = links.join(ids.withColumnRenamed("node", src), src, "left_anti").join(ids.withColumnRenamed("node", dst), dst, "left_anti")
    return nodes.join(ids, "node", "left_anti"), left


def ingest(messages: DataFrame, entities: DataFrame, topics: DataFrame, relations: DataFrame, least_relevance: float, least_length: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, kind) and links (source, target, type) of an analysis: messages mention entities that are relevant and
    long enough and are tagged with lower-cased topics; relations link entities that exist; messages are part of conversations."""
    kept = entities.where((F.col("relevance") >= least_relevance) & (F.length("label") >= least_length))
    names = kept.select("label").distinct()
    nodes = names.withColumn("kind", F.lit("entity")).unionByName(topics.select(F.lower("topic").alias("label"), F.lit("topic").alias("kind")).distinct())
    known = relations.join(names.select(F.col("label").alias("subject")), "subject", "left_semi").join(names.select(F.col("label").alias("object")), "object", "left_semi")
    edge = lambda df, a, b, t: df.select(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), (F.lit(t) if isinstance(t, str) else t).alias("type")).distinct()
    low = topics.withColumn("topic", F.lower("topic"))
    return nodes, edge(kept, "message", "label", "mentions").unionByName(edge(low, "message", "topic", "tagged_with")).unionByName(edge(known, "subject", "object", F.col("predicate"))).unionByName(edge(messages, "message", "conversation", "part_of"))


def directed(links: DataFrame, direction: str, src: str = "source", dst: str = "target") -> DataFrame:
    """Links as they are walked: ``out``, ``in`` or ``both``."""
    if direction == "both":
        return undirected(links.select(src, dst), src, dst)
    return links.select(src, dst) if direction == "out" else links.select(F.col(dst).alias(src), F.col(src).alias(dst))


def perspective(nodes: DataFrame, links: DataFrame, kinds: list[str], direction: str, hops: int, seeds: DataFrame | None, shown: Column, limit: int) -> DataFrame:
    """Nodes of a view with their depth: walked from the seeds (or all nodes) over links of the kinds, those that are shown
    (seeds always), nearest first up to ``limit``."""
    start = nodes.select("node") if seeds is None else seeds.select("node")
    walked = bfs(directed(links.where(F.col("type").isin(kinds)), direction), start, hops)
    rows = walked.join(nodes, "node").where(shown | (F.col("depth") == 0))
    return rows.orderBy("depth", "node").limit(limit)


def with_inverses(links: DataFrame, registry: DataFrame) -> DataFrame:
    """Links with what the relation registry (type, inverse, symmetric) says of their other direction, each once."""
    known = links.select("source", "target", "type").join(F.broadcast(registry), "type", "left")  # a row per relation type
    back = known.where(F.col("symmetric") | F.col("inverse").isNotNull()).select(F.col("target").alias("source"), F.col("source").alias("target"), F.when(F.col("symmetric"), F.col("type")).otherwise(F.col("inverse")).alias("type"))
    return links.select("source", "target", "type").unionByName(back).distinct()


def isomorphisms(links: DataFrame, nodes: DataFrame, pattern_links: list[tuple[str, str, str]], labels: dict[str, str]) -> DataFrame:
    """Injective, non-induced occurrences of a connected pattern of links (variable, variable, type) in a multigraph: one
    column per variable. A variable's candidates have its label and at least its degrees; each pattern link is one join."""
    out_degree, in_degree = links.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("_out")), links.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("_in"))
    known = materialize(nodes.join(out_degree, "node", "left").join(in_degree, "node", "left").fillna(0, ["_out", "_in"]))
    names = list(dict.fromkeys(v for x, y, _ in pattern_links for v in (x, y)))
    need = {v: (sum(x == v for x, _, _ in pattern_links), sum(y == v for _, y, _ in pattern_links)) for v in names}

    def domain(v: str) -> DataFrame:
        rows = known.where((F.col("_out") >= need[v][0]) & (F.col("_in") >= need[v][1]))
        return (rows.where(F.col("label") == labels[v]) if v in labels else rows).select(F.col("node").alias(v))

    edges = [links.where(F.col("type") == t).select(F.col("source").alias(x), F.col("target").alias(y)).distinct().join(domain(x), x, "left_semi").join(domain(y), y, "left_semi") for x, y, t in pattern_links]
    rows, left = edges[0], edges[1:]
    rows = rows.where(F.col(pattern_links[0][0]) != F.col(pattern_links[0][1]))
    while left:
        k = next((k for k, e in enumerate(left) if set(e.columns) & set(rows.columns)), None)
        if k is None:
            raise ValueError("the pattern isn't connected")
        edge = left.pop(k)
        fresh = [c for c in edge.columns if c not in rows.columns]
        rows = rows.join(edge, [c for c in edge.columns if c in rows.columns])
        for c in fresh:  # injective: at once, so that partial matches stay few
            rows = rows.where(reduce(Column.__and__, (F.col(c) != F.col(d) for d in rows.columns if d != c)))
    return rows.select(*names)


def motifs(links: DataFrame, nodes: DataFrame, group: str, least_groups: int) -> DataFrame:
    """Neighbourhood shapes of radius one that occur in at least ``least_groups`` groups of nodes: the shape as text (label,
    then its links in order with counts), occurrences, groups and an example. Shapes are exact, so equal text is equal shape."""
    label = nodes.select("node", "label")
    sides = [("out", "source", "target"), ("in", "target", "source")]
    near = reduce(DataFrame.unionByName, [links.join(label.withColumnRenamed("node", far), far).select(F.col(own).alias("node"), F.concat_ws(":", F.lit(side), "type", "label").alias("tie")) for side, own, far in sides])
    counted = near.groupBy("node", "tie").agg(F.count("*").alias("n"))
    shape = counted.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("*", "tie", F.col("n").cast("string")))), " ").alias("ties"))
    whole = nodes.join(shape, "node").select("node", group, F.concat_ws(" | ", "label", "ties").alias("shape"))
    return whole.groupBy("shape").agg(F.count("*").alias("occurrences"), F.countDistinct(group).alias("groups"), F.min("node").alias("example")).where(F.col("groups") >= least_groups)


def rank_graphs(features: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Host graphs by how much of a query graph's features (feature, n) they contain: containment = sum min(n, asked) / sum
    asked, then cosine, then host; ``features`` is (host, feature, n)."""
    asked = query.groupBy("feature").agg(F.sum("n").alias("q"))
    size = asked.agg(F.sum("q").alias("all"), F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    norm = features.groupBy("host").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("hn"))
    hit = features.join(asked, "feature").groupBy("host").agg(F.sum(F.least("n", "q")).alias("both"), F.sum(F.col("n") * F.col("q")).alias("dot"))
    scored = hit.join(norm, "host").join(F.broadcast(size))
    out = scored.select("host", F.round(F.col("both") / F.col("all"), 6).alias("containment"), F.round(F.col("dot") / F.col("hn") / F.col("qn"), 6).alias("cosine"))
    return out.orderBy(F.desc("containment"), F.desc("cosine"), "host").limit(k)


def _stored(df: DataFrame) -> DataFrame:
    """A round's table, written: one run, and the next plan knows nothing of how it came about. (A checkpoint hands the
    constraints of its plan on, and over many rounds the optimizer spends ever longer on them.)"""
    return written(df, "rounds")


def louvain(links: DataFrame, most_rounds: int = 6, most_levels: int = 3, least_gain: float = 1e-3) -> DataFrame:
    """(node, community) by modularity, over undirected weighted links (source, target, weight).

    The local moves of a level run for all nodes at once: in turn one half of the nodes, by a hash of node and round, may move
    to the neighbouring community of largest positive gain (ties to the smaller community), so two neighbours seldom swap.
    A round that doesn't raise modularity by ``least_gain`` is undone, and two of them in turn end a level; then communities become nodes. The driver sees
    one number a round. Communities are named by their smallest node.
    """
    flat = links.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "weight")
    level = _stored(flat.groupBy("a", "b").agg(F.sum("weight").alias("w")))
    total = 2.0 * level.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    names = _stored(level.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node")))
    if not total:
        return names
    loops = names.select("node", F.lit(0.0).alias("loop"))
    for _ in range(most_levels):
        both = _stored(level.select(F.col("a").alias("node"), F.col("b").alias("to"), "w").unionByName(level.select(F.col("b").alias("node"), F.col("a").alias("to"), "w")))
        degree = _stored(loops.join(both.groupBy("node").agg(F.sum("w").alias("d")), "node", "left").select("node", (F.coalesce("d", F.lit(0.0)) + F.col("loop")).alias("k"), "loop"))
        state = _stored(degree.select("node", F.col("node").alias("c")))
        best, moved, idle = _modularity(both, degree, state, total), False, 0
        for k in range(most_rounds):
            size = state.join(degree, "node").groupBy("c").agg(F.sum("k").alias("s"))
            near = both.join(state.select(F.col("node").alias("to"), "c"), "to").groupBy("node", "c").agg(F.sum("w").alias("w"))
            own = state.select("node", F.col("c").alias("mine")).join(degree.select("node", "k"), "node")
            choice = near.join(own, "node").join(size, "c")
            s = F.col("s") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(F.lit(0.0))
            gain = F.col("w") - F.col("k") * s / total
            ranked = choice.select("node", "mine", "c", F.round(gain, 9).alias("gain"))
            stay = F.max(F.when(F.col("c") == F.col("mine"), F.col("gain")))
            top = ranked.groupBy("node", "mine").agg(F.max(F.struct("gain", (-F.col("c")).alias("low"))).alias("t"), stay.alias("stay"))
            # staying alone in one's community without a link inside it gains what the size of the rest costs
            alone = top.join(size.withColumnRenamed("c", "mine"), "mine").join(degree.select("node", "k"), "node")
            home = F.coalesce("stay", F.round(-F.col("k") * (F.col("s") - F.col("k")) / total, 9))
            turn = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
            to = F.when(turn & (F.col("t.gain") > home), -F.col("t.low")).otherwise(F.col("mine"))
            new = _stored(state.join(alone.select("node", to.alias("to")), "node", "left").select("node", F.coalesce("to", "c").alias("c")))
            q = _modularity(both, degree, new, total)
            if q > best + least_gain:
                state, best, moved, idle = new, q, True, 0
            else:
                idle += 1
                if idle == 2:
                    break
        if not moved:
            break
        low = state.groupBy("c").agg(F.min("node").alias("name"))
        state = _stored(state.join(low, "c").select("node", "name"))
        names = _stored(names.join(state.select(F.col("node").alias("community"), "name"), "community").select("node", F.col("name").alias("community")))
        ends = level.join(state.select(F.col("node").alias("a"), F.col("name").alias("x")), "a").join(state.select(F.col("node").alias("b"), F.col("name").alias("y")), "b")
        inside = ends.where("x = y").groupBy(F.col("x").alias("node")).agg((2 * F.sum("w")).alias("l"))
        old = loops.join(state, "node").groupBy(F.col("name").alias("node")).agg(F.sum("loop").alias("loop"))
        loops = _stored(old.join(inside, "node", "left").select("node", (F.col("loop") + F.coalesce("l", F.lit(0.0))).alias("loop")))
        level = _stored(ends.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))
    low = names.groupBy("community").agg(F.min("node").alias("name"))
    return names.join(low, "community").select("node", F.col("name").alias("community"))


def _modularity(both: DataFrame, degree: DataFrame, state: DataFrame, total: float) -> float:
    a = both.join(state, "node").join(state.select(F.col("node").alias("to"), F.col("c").alias("c2")), "to").where("c = c2").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    sums = degree.join(state, "node").groupBy("c").agg(F.sum("k").alias("s"))
    loops, squares = degree.agg(F.sum("loop")).first()[0], sums.agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return (a + loops) / total - squares / total**2


def stated_facts(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Facts (source, target, type) of transitive relations, in both directions where the registry (type, inverse, symmetric,
    transitive) says so, each once. An inverse is transitive as its relation is."""
    known = facts.join(F.broadcast(registry.where("transitive")), "type")  # a row per relation type
    back = known.where(F.col("symmetric") | F.col("inverse").isNotNull()).select(F.col("target").alias("source"), F.col("source").alias("target"), F.when(F.col("symmetric"), F.col("type")).otherwise(F.col("inverse")).alias("type"))
    return known.select("source", "target", "type").unionByName(back).distinct()


def extended_closure(closure: DataFrame, facts: DataFrame, most: int = 64) -> DataFrame:
    """The closure (source, target, type) of transitive relations with new facts of the same columns.

    Only what is new is joined: with what was known before it and after it, and again with what came of that, until nothing
    does. Pairs of new facts meet too, so a batch's order doesn't matter. A cycle relates its members to themselves. Each round
    at least doubles the length of the new paths that are covered; raises after ``most`` rounds.
    """
    known = _stored(closure.select("source", "target", "type").distinct())
    new = _stored(facts.select("source", "target", "type").distinct().join(known, ["source", "target", "type"], "left_anti"))
    for _ in range(most):
        if new.isEmpty():
            return known
        every = _stored(known.unionByName(new))
        before = every.select("source", F.col("target").alias("_via"), "type").join(new.select(F.col("source").alias("_via"), "target", "type"), ["_via", "type"])
        after = new.select("source", F.col("target").alias("_via"), "type").join(every.select(F.col("source").alias("_via"), "target", "type"), ["_via", "type"])
        found = before.select("source", "target", "type").unionByName(after.select("source", "target", "type")).distinct()
        known, new = every, _stored(found.join(every, ["source", "target", "type"], "left_anti"))
    raise RuntimeError(f"the closure did not end in {most} rounds")
