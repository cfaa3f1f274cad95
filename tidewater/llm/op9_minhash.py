"""Near-duplicates by SuperMinHash signatures, banding, verification on full shingle sets and union-find grouping.

SuperMinHash gives element x, at step j, the rank j + r in the lane that a random permutation of the lanes puts j-th for
x: an element's ranks are spread evenly over the lanes instead of drawn independently, which lowers the variance of the
estimate, and once every lane of a text is filled no later step can lower any, so the steps stop early.

Documents with equal shingle sets are one class, represented by its smallest id, so exact copies never meet in pairs.
Representatives that agree in all rows of a band are candidates. In each bucket they are compared with one pivot, not with
each other. Pairs of different components that still share a bucket are then compared, in small buckets one by one
and in large ones block against block, so no link between different texts is lost and no list of all pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import pieces as P
from tidewater.llm.components import UnionFind, components
from tidewater.llm.shingles import mix, shingle_sets
from tidewater.workspace import compacted, materialize, written

LANES, ROWS = 160, 5
_FIRST_ID = -(2**63)
_EMPTY = np.uint64(2**64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
GROUP = 60_000  # elements handled at once: bounds the permutations held


def superminhash(elements: np.ndarray, bounds: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Signatures (sets x lanes) of sets of 64-bit hashes; lanes of an empty set stay at the largest value."""
    n = len(bounds) - 1
    out = np.full((n, lanes), _EMPTY, np.uint64)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + GROUP, side="right")) - 1)
        for c in range(int(bounds[a]), int(bounds[b]), 16 * GROUP) if b == a + 1 else [int(bounds[a])]:
            # a single very large set is taken in parts: signatures of unions are lane-wise minima
            d = min(int(bounds[b]), c + 16 * GROUP) if b == a + 1 else int(bounds[b])
            own = np.repeat(np.arange(a, b), np.diff(np.clip(bounds[a : b + 1], c, d)))
            _fill(out, elements[c:d], own, lanes)
        a = b
    return out


def _fill(out: np.ndarray, x: np.ndarray, own: np.ndarray, lanes: int) -> None:
    flat = out.reshape(-1)
    base = own * lanes
    swapped = None
    for j in range(lanes):
        draw = mix(x + np.uint64((j + 1) * int(_STEP) % 2**64))
        k = j + ((draw >> np.uint64(32)) % np.uint64(lanes - j)).astype(np.int64)
        rank = (draw & np.uint64(0xFFFFFFFF)) | (np.uint64(j) << np.uint64(32))
        rows = np.arange(len(x))
        if j == 0:
            lane = k
        else:
            lane = swapped[rows, k]
            swapped[rows, k] = swapped[:, j]
        np.minimum.at(flat, base + lane, rank)
        texts = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        open_texts = texts[(out[texts] == _EMPTY).any(axis=1)]
        if not len(open_texts):
            return
        keep = np.flatnonzero(np.isin(own, open_texts)) if len(open_texts) < len(texts) else slice(None)
        if j == 0:
            x, own, base, k = x[keep], own[keep], base[keep], k[keep]
            swapped = np.tile(np.arange(lanes, dtype=np.uint8 if lanes <= 256 else np.int32), (len(x), 1))
            swapped[np.arange(len(x)), k] = 0
        elif len(open_texts) < len(texts):
            x, own, base, swapped = x[keep], own[keep], base[keep], swapped[keep]


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band: the band's number and its lanes."""
    n, lanes = signatures.shape
    lane = signatures.reshape(n, lanes // rows, rows)
    key = np.broadcast_to(mix(np.arange(lanes // rows, dtype=np.uint64) + _STEP), lane.shape[:2]).copy()
    for r in range(rows):
        key = mix((key * np.uint64(0xE7037ED1A0B428DB)) ^ lane[:, :, r])
    return key


SIGNED = "d long, n long, a long, b long, bands array<long>"


def sign(docs: DataFrame, k: int, lanes: int, rows: int) -> DataFrame:
    """Per row: id d, set size n, a 128-bit key of the set, and its band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = P.buffers(batch.column(1))
            for a, b in P.slices(offsets, 1 << 20):
                sets, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                n = np.diff(bounds)
                keys = [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ salt))])[bounds]) for salt in (np.uint64(0), _STEP)]
                full = np.flatnonzero(n > 0)
                bands = band_keys(superminhash(sets, np.concatenate([[0], np.cumsum(n[full])]), lanes), rows)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, lanes // rows, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), *(pa.array(x.view(np.int64)) for x in keys),
                     pa.ListArray.from_arrays(ends, pa.array(bands.view(np.int64).ravel()))],
                    ["d", "n", "a", "b", "bands"],
                )

    return docs.mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """Per row: id d and its whole set, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = P.buffers(batch.column(1))
            for a, b in P.slices(offsets, 1 << 20):
                sets, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                body = [sets[s:e].tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(body, pa.binary())], ["d", "set"])

    return docs.mapInArrow(run, "d long, set binary")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether the Jaccard similarity of two sets is at least ``percent`` hundredths."""
    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, x, y = (batch.column(c) for c in range(4))
            good = [similar(p.as_py(), q.as_py(), percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("d").alias("u"), F.col("set").alias("x"))
    two = sets.select(F.col("d").alias("v"), F.col("set").alias("y"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def _sized(percent: int):
    return F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")


def star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each bucket's members with its smallest member."""
    pivot = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p"))
    return _ordered(members.join(pivot, "key").withColumn("m", F.col("p.n")).where(_sized(percent)).select(F.col("rep").alias("u"), F.col("p.rep").alias("v")))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.select(F.col("node").alias("rep"), F.col("root").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


SMALL, BLOCK = 16, 256


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels and bucket sizes, of the buckets that hold several components."""
    known = _labelled(members, labels)
    mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high")
    return known.join(mixed.select("key", "low", "size"), "key")


def small_rest(mixed: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Untested pairs of different components in buckets of at most SMALL members."""
    own = mixed.where(F.col("size") <= SMALL)
    other = own.select("key", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("label").alias("label2"))
    pairs = own.join(other, "key").where((F.col("rep") < F.col("other")) & (F.col("label") != F.col("label2")) & _sized(percent))
    return _ordered(pairs.select(F.col("rep").alias("u"), F.col("other").alias("v"))).join(tested, ["u", "v"], "left_anti")


def large_rest(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a bucket of more than SMALL members, found without listing pairs.

    Components that share such buckets form a cluster. Its members are packed into blocks, large components into blocks of
    their own; two blocks are compared at once by a matrix product, unless both are of one component, and report at most
    one link for each union they make.
    """
    big = mixed.where(F.col("size") > SMALL)
    clusters = components(big.select(F.col("label").alias("u"), F.col("low").alias("v")))
    clustered = big.select("rep", "label").distinct().join(clusters.select(F.col("node").alias("label"), F.col("root").alias("cluster")), "label", "left")
    clustered, _ = compacted(clustered.withColumn("cluster", F.coalesce("cluster", "label")))
    per_label = clustered.groupBy("cluster", "label").agg(F.count("*").alias("c")).withColumn("own", F.when(F.col("c") >= BLOCK, F.col("label")))
    pools = per_label.groupBy("cluster", "own").agg(F.ceil(F.sum("c") / BLOCK).cast("long").alias("blocks"))
    placed = clustered.join(per_label, ["cluster", "label"]).join(pools.withColumnRenamed("own", "pool"), ["cluster"]).where(F.col("own").eqNullSafe(F.col("pool")))
    placed = placed.select("cluster", "own", F.xxhash64("cluster", F.coalesce("own", F.lit(-1)), F.pmod(F.xxhash64("rep"), "blocks")).alias("block"), "rep", "label")
    packed = written(placed.join(sets.withColumnRenamed("d", "rep"), "rep").groupBy("cluster", "own", "block").agg(F.collect_list(F.struct("rep", "label", "set")).alias("rows")), "blocks")
    head = packed.select("cluster", "own", F.col("block").alias("b1"))
    couples = head.join(packed.select("cluster", F.col("own").alias("own2"), F.col("block").alias("b2")), "cluster").where("b1 <= b2 and not (own is not null and own <=> own2)")
    one, two = packed.select(F.col("block").alias("b1"), F.col("rows").alias("r1")), packed.select(F.col("block").alias("b2"), F.col("rows").alias("r2"))
    pairs = couples.select("b1", "b2").join(one, "b1").join(two, "b2").select("r1", "r2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                found = block_links(x.as_py(), y.as_py(), percent)
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return pairs.repartition(F.xxhash64("r1.rep", "r2.rep")).mapInArrow(run, "u long, v long")


def block_links(one: list[dict], two: list[dict], percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """Links (u < v) between rows of two blocks with different labels: enough of them to join what is linked."""
    xs, ys = ([np.frombuffer(r["set"], np.uint64) for r in side] for side in (one, two))
    common = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    shared = np.zeros((len(xs), len(ys)), np.float32)
    for c in range(0, len(common), columns):
        part = common[c : c + columns]
        sides = []
        for rows in (xs, ys):
            hot = np.zeros((len(rows), len(part)), np.float32)
            for k, row in enumerate(rows):
                hot[k, np.searchsorted(part, row[np.isin(row, part, assume_unique=True)])] = 1
            sides.append(hot)
        shared += sides[0] @ sides[1].T
    total = np.array([len(x) for x in xs])[:, None] + np.array([len(y) for y in ys])[None, :] - shared
    good = np.argwhere(100 * shared >= percent * total)
    sets, out = UnionFind(), []
    for i, j in good.tolist():
        a, b = one[i], two[j]
        if a["label"] != b["label"] and sets.find(a["label"]) != sets.find(b["label"]):
            sets.union(a["label"], b["label"])
            out.append((min(a["rep"], b["rep"]), max(a["rep"], b["rep"])))
    return out


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id d (a null one is the smallest) and two 64-bit hashes of the text, h and g, null for a null text."""
    text = F.col(text_col).cast("string")
    hashed = [F.when(text.isNotNull(), F.xxhash64(*salt, text)).alias(name) for name, salt in (("h", []), ("g", [F.lit(7)]))]
    return docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_ID)).alias("d"), *hashed)


def numbered(docs: DataFrame, id_col: str, text_col: str, row: str) -> tuple[DataFrame, DataFrame | None]:
    """The input with a number ``row`` per row, equal for rows equal in id and text only and ordered as the ids, and a
    table (row, d) of the numbers' ids; where no id has several texts, the ids are the numbers and the table is None."""
    keyed = _ids(docs, id_col, text_col)
    texts = keyed.groupBy("d").agg(F.min("h").alias("h1"), F.max("h").alias("h2"), F.min("g").alias("g1"), F.max("g").alias("g2"), F.count("h").alias("known"), F.count("*").alias("n"))
    if texts.where("h1 <> h2 or g1 <> g2 or known between 1 and n - 1").isEmpty():
        return keyed.withColumn(row, F.col("d")).select(*docs.columns, row), None
    # stored in order first: the numbers then rise with partition and place
    distinct = written(keyed.select("d", "h", "g").distinct().orderBy("d", "h", "g").withColumn(row, F.monotonically_increasing_id()), "row-numbers")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("d", "h", "g")]
    given = keyed.alias("a").join(distinct.alias("b"), same).select(*[F.col(f"a.{c}") for c in docs.columns], F.col(f"b.{row}"))
    return written(given, "numbered-rows"), distinct.select(row, "d")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, lanes: int = LANES, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Component of every row: doc_id, n_shingles, component_id (the smallest id reachable by links), kept.

    Two documents are linked if their sets of ``shingle``-word shingles have a Jaccard similarity of ``percent``/100 or
    more; candidates at exactly 0.8 are missed with probability (1 - 0.8^rows)^(lanes/rows), 3e-6 as set. Null and empty
    texts have an empty set, are linked with nothing and kept. Rows equal in id and text are one document; other rows of
    one id are documents of their own, of which the first of a component by id and text hash is kept. A null id is the
    smallest one. Other columns aren't read.
    """
    rows_of, ids = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text", "row")
    out = near_rows(rows_of, "row", "text", shingle, percent, lanes, rows)
    if ids is not None:
        own = lambda a, b: ids.select(F.col("row").alias(a), F.col("d").alias(b))
        out = out.join(own("row", "d"), "row").join(own("first", "component"), "first")
    else:
        out = out.withColumns({"d": F.col("row"), "component": F.col("first")})
    back = lambda c: F.when(F.col(c) != _FIRST_ID, F.col(c)).alias
    return out.select(back("d")("doc_id"), "n_shingles", back("component")("component_id"), "kept")


def near_rows(docs: DataFrame, row: str, text_col: str, shingle: int = 5, percent: int = 80, lanes: int = LANES, rows: int = ROWS) -> DataFrame:
    """Component of every row by its number from :func:`numbered`: row, n_shingles, first (the component's smallest), kept."""
    slim = docs.select(F.col(row).alias("d"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(sign(slim, shingle, lanes, rows))
    classes = signed.where("n > 0").groupBy("a", "b").agg(F.min("d").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    multi = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members, _ = compacted(keyed.join(multi, "key").select("key", "rep", "n"))
    sets = written(full_sets(slim.join(members.select(F.col("rep").alias("d")).distinct(), "d", "left_semi"), shingle), "shingle-sets")
    links, labels = _link(members, sets, percent)
    roots = labels.select(F.col("node").alias("rep"), "root")
    mapped = classes.drop("bands").join(roots, "rep", "left").where("copies > 1 or root is not null").select("a", "b", F.coalesce("root", "rep").alias("component"))
    out = signed.drop("bands").join(mapped, ["a", "b"], "left")
    first = F.when(F.col("n") > 0, F.coalesce("component", "d")).otherwise(F.col("d"))
    return out.select(F.col("d").alias("row"), F.col("n").alias("n_shingles"), first.alias("first"), (first == F.col("d")).alias("kept"))


def _link(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Verified links between representatives, enough to join all that is linked, and (node, root) of their components."""
    tested, _ = compacted(star_pairs(members, percent))
    links, _ = compacted(verify(tested, sets, percent))
    labels = components(links)
    mixed, n = compacted(mixed_buckets(members, labels))
    if not n:
        return links, labels
    found = verify(small_rest(mixed, tested, percent), sets, percent)
    if not mixed.where(F.col("size") > SMALL).isEmpty():
        found = found.unionByName(large_rest(mixed, sets, percent))
    found, n = compacted(found)
    if n:
        links = links.unionByName(found)
        labels = components(links)
    return links, labels
