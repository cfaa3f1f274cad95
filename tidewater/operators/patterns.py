"""Recurring rooted neighbourhoods of any radius in a labelled, directed multigraph.

Every node's neighbourhood grows by joins, a step at a time; one that passes the bound on its nodes is dropped before the
join that would make it large, and counted. Neighbourhoods meet by their colour-refinement fingerprint, which equal shapes
share; only those that share it get a canonical form, which shapes share exactly if they are isomorphic with equal roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.workspace import materialize, written

Edge = tuple[int, int, str]


def _refined(colours: list, edges: list[Edge]) -> list[int]:
    """Colours by number after refinement to a fixed point; equal graphs get equal numbers."""
    count = 0
    while True:
        ranks = {c: k for k, c in enumerate(sorted(set(colours)))}
        now = [ranks[c] for c in colours]
        if len(ranks) == count:
            return now
        count = len(ranks)
        around: list[list] = [[] for _ in now]
        for a, b, label in edges:
            around[a].append((0, label, now[b]))
            around[b].append((1, label, now[a]))
        colours = [(c, tuple(sorted(x))) for c, x in zip(now, around, strict=True)]


def _twins(x: int, y: int, edges: list[Edge]) -> bool:
    """Whether exchanging two nodes leaves the graph as it is."""
    swap = {x: y, y: x}
    return sorted(edges) == sorted((swap.get(a, a), swap.get(b, b), label) for a, b, label in edges)


def fingerprint(labels: list[str], edges: list[Edge]) -> str:
    """Digest of the multiset of colours, of the nodes and of the edges' ends."""
    names: list = [(x,) for x in labels]
    for _ in range(len(labels)):
        around: list[list] = [[] for _ in names]
        for a, b, label in edges:
            around[a].append((0, label, names[b]))
            around[b].append((1, label, names[a]))
        new = [hashlib.sha256(repr((n, sorted(x))).encode()).hexdigest() for n, x in zip(names, around, strict=True)]
        if len(set(new)) == len(set(names)):
            names = new
            break
        names = new
    return hashlib.sha256(repr(sorted(names)).encode()).hexdigest()


def canonical(labels: list[str], edges: list[Edge]) -> str:
    """The least listing of labels and edges over all orders of the nodes that refinement leaves open: equal exactly for
    isomorphic graphs. Of nodes that can be exchanged one is tried."""
    best: str | None = None

    def search(colours: list) -> None:
        nonlocal best
        now = _refined(colours, edges)
        cells: dict[int, list[int]] = {}
        for node, c in enumerate(now):
            cells.setdefault(c, []).append(node)
        open_cell = next((cells[c] for c in sorted(cells) if len(cells[c]) > 1), None)
        if open_cell is None:
            order = sorted(range(len(now)), key=now.__getitem__)
            place = {node: k for k, node in enumerate(order)}
            text = repr(([labels[n] for n in order], sorted((place[a], place[b], label) for a, b, label in edges)))
            best = text if best is None else min(best, text)
            return
        tried: list[int] = []
        for node in open_cell:
            if not any(_twins(node, t, edges) for t in tried):
                tried.append(node)
                search([(c, 0 if n == node else 1) for n, c in enumerate(now)])

    search(list(labels))
    return best or repr(([], []))


def neighbourhoods(links: DataFrame, nodes: DataFrame, radius: int, most_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(members, dropped): (root, node, depth) of every node's neighbourhood over links in both directions, and the roots whose
    neighbourhood has more than ``most_nodes`` nodes. A node of that many neighbours drops every root it would be grown from."""
    near = materialize(links.where("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(links.where("source <> target").select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct())
    hubs = materialize(near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= most_nodes).select(F.col("a").alias("node")))
    members = materialize(nodes.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")))
    dropped = members.select("root").limit(0)
    for step in range(1, radius + 1):
        edge = members.where(F.col("depth") == step - 1)
        full = edge.join(hubs, "node", "left_semi").select("root").distinct()
        grown = edge.join(full, "root", "left_anti").join(near.select(F.col("a").alias("node"), "b"), "node").select("root", F.col("b").alias("node")).distinct()
        new = grown.join(members.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(step))
        every = written(members.join(full, "root", "left_anti").unionByName(new), "neighbourhoods")
        large = every.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most_nodes).select("root")
        out = materialize(full.unionByName(large).distinct())
        dropped = dropped.unionByName(out)
        members = every.join(out, "root", "left_anti")
    return members, dropped


def shapes(links: DataFrame, nodes: DataFrame, radius: int, most_nodes: int = 12, least_nodes: int = 2) -> DataFrame:
    """(root, fingerprint, labels, edges) of neighbourhoods with their induced links (source, target, type) and the labels of
    ``nodes`` (node, label). A root's label is marked. ``edges`` are (source, target, type) by place among ``labels``. Links of nodes
    that ``nodes`` lacks have no place, and are left out."""
    known = nodes.select("node", F.coalesce("label", F.lit("")).alias("label"))
    within = links.join(known.select(F.col("node").alias("source")), "source", "left_semi").join(known.select(F.col("node").alias("target")), "target", "left_semi")
    members = neighbourhoods(within, known, radius, most_nodes)[0]
    mark = F.when(F.col("root") == F.col("node"), F.lit("*")).otherwise(F.lit("-"))
    placed = members.join(known, "node").select("root", "node", F.concat(mark, "label").alias("label"))
    listed = placed.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("l")).where(F.size("l") >= least_nodes)
    held = materialize(listed.select("root", F.transform("l", lambda x: x["node"]).alias("ids"), F.transform("l", lambda x: x["label"]).alias("labels")))
    inner = placed.select("root", F.col("node").alias("source")).join(within.select("source", "target", F.coalesce("type", F.lit("")).alias("type")), "source").join(placed.select("root", F.col("node").alias("target")), ["root", "target"])
    tied = inner.groupBy("root").agg(F.collect_list(F.struct("source", "target", "type")).alias("e"))
    place = lambda x: (F.array_position("ids", x) - 1).cast("int")
    rows = held.join(tied, "root").select("root", "labels", F.transform("e", lambda e: F.struct(place(e["source"]).alias("a"), place(e["target"]).alias("b"), e["type"].alias("t"))).alias("edges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["fingerprint"] = [fingerprint(list(x), [(e["a"], e["b"], e["t"]) for e in es]) for x, es in zip(batch["labels"], batch["edges"], strict=True)]
            yield batch

    kind = nodes.schema["node"].dataType.simpleString()
    return rows.mapInPandas(run, f"root {kind}, labels array<string>, edges array<struct<a:int,b:int,t:string>>, fingerprint string")


def recurring(links: DataFrame, nodes: DataFrame, radius: int, most_nodes: int = 12, least: int = 2, group: str | None = None) -> DataFrame:
    """(pattern, nodes, links, occurrences, groups, example) of neighbourhoods of ``radius`` that occur ``least`` times or more. ``groups``
    counts the distinct values of the column ``group`` of ``nodes`` among the roots; ``example`` is the smallest root."""
    found = written(shapes(links, nodes, radius, most_nodes), "shapes")
    often = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("fingerprint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = [canonical(list(x), [(e["a"], e["b"], e["t"]) for e in es]) for x, es in zip(batch["labels"], batch["edges"], strict=True)]
            yield pd.DataFrame({"root": batch["root"], "pattern": [hashlib.sha256(f.encode()).hexdigest()[:24] for f in forms], "nodes": [len(x) for x in batch["labels"]], "links": [len(x) for x in batch["edges"]]})

    kind = nodes.schema["node"].dataType.simpleString()
    exact = found.join(often, "fingerprint", "left_semi").select("root", "labels", "edges").mapInPandas(run, f"root {kind}, pattern string, nodes int, links int")
    of = nodes.select(F.col("node").alias("root"), (F.col(group) if group else F.lit(None).cast("string")).alias("_g"))
    counted = exact.join(of, "root").groupBy("pattern", "nodes", "links").agg(F.count("*").alias("occurrences"), F.countDistinct("_g").alias("groups"), F.min("root").alias("example"))
    return counted.where(F.col("occurrences") >= least)
