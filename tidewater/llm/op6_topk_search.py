"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size; each block's rows are sorted by every dimension once, and the lists travel
with the block. A query walks all lists at once, from the end that its component's sign favours, in rounds of doubling depth,
and scores each row once, in the round in which it first appears in any list. No row that hasn't appeared can score more than
the threshold, the query's product with the values now reached; the walk ends when that cannot beat the k-th result, nor tie
with it, or when every row has appeared. A task takes several blocks in turn and starts each from the k-th result so far; a
block whose extremes cannot reach it is passed over. The best of all tasks are merged.

How early a walk ends depends on the data: see :func:`walks`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.workspace import written

SCALE = 64
BLOCK, LANE, QUERIES = 4_096, 8, 1_024  # rows of a block of vectors, blocks that a task takes in turn, rows of a block of queries
FIRST_DEPTH = 16
SCHEMA = "query_row long, query_id long, vec_id long, score long"
WALKS = "query_row long, query_id long, rows long, scored long, deepest long"
PACKED = "block long, rows binary, ids binary, kind string, width int, body binary, lists binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v) with floor(64 x) of every component; rows with a null id, a null vector, or a null or non-finite component
    are left out. Rows that share an id stay rows of their own, told apart by ``row``; the table is stored, so it keeps them."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # nulls among the components must not reach forall's result as null
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("v"))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")


def pack(rows: DataFrame, size: int, n: int, with_lists: bool) -> DataFrame:
    """Blocks of about ``size`` rows as matrices of the smallest integer type that holds them, rows in ascending id, and if
    asked for each dimension's list of rows in ascending order."""
    blocks = max(1, -(-n // size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"])
        width = max(map(len, pdf["v"]))
        matrix = np.zeros((len(pdf), width), np.int64)
        for k, v in enumerate(pdf["v"]):
            matrix[k, : len(v)] = v
        most = int(np.abs(matrix).max(initial=0))
        kind = next(t for t, limit in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1), ("i8", 2**63)) if most <= limit)
        matrix = matrix.astype(kind)
        lists = sorted_lists(matrix).tobytes() if with_lists else b""
        return pd.DataFrame([[pdf["block"].iloc[0], pdf["row"].to_numpy(np.int64).tobytes(), pdf["vec_id"].to_numpy(np.int64).tobytes(), kind, width, matrix.tobytes(), lists]], columns=["block", "rows", "ids", "kind", "width", "body", "lists"])

    return rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block").applyInPandas(run, PACKED)


def sorted_lists(matrix: np.ndarray) -> np.ndarray:
    """Row numbers in ascending order of every dimension, one dimension a row."""
    return np.argsort(matrix, axis=0, kind="stable").T.astype("<i4")


def unpack(row, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Row keys, ids, the matrix with ``width`` columns and the lists of its dimensions, all rows in order for the added ones."""
    ids = np.frombuffer(row["ids"], np.int64)
    own = np.frombuffer(row["body"], row["kind"]).reshape(len(ids), row["width"]).astype(np.int64)
    lists = None
    if row["lists"]:
        lists = np.frombuffer(row["lists"], "<i4").reshape(row["width"], len(ids))
        lists = np.concatenate([lists, np.tile(np.arange(len(ids), dtype="<i4"), (width - row["width"], 1))])
    return np.frombuffer(row["rows"], np.int64), ids, np.pad(own, ((0, 0), (0, width - own.shape[1]))), lists


class Best:
    """The k best rows so far of each query; unused places hold the least score and no row."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.zeros((queries, k), np.int64)
        self.exact = [[] for _ in range(queries)]  # scores as whole numbers

    def kth(self) -> np.ndarray:
        """A bound that the k-th score reaches: itself, or a little less where a double doesn't hold it."""
        last = self.scores[:, -1]
        return np.where(np.abs(last) < 2.0**53, last, last - 1e-9 * np.abs(last))

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge rows that no earlier block held; of equal scores the smaller ids stay."""
        n = len(self.exact[q])
        all_ids = np.concatenate([self.ids[q, :n], ids])
        all_scores = np.concatenate([np.array(self.exact[q], np.int64), scores.astype(np.int64)])
        order = np.lexsort((all_ids, -all_scores))[: self.k]
        self.exact[q] = all_scores[order].tolist()
        self.ids[q, : len(order)] = all_ids[order]
        self.scores[q, : len(order)] = all_scores[order]


class SortedLists:
    """A block's rows sorted by every dimension, for threshold searches."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, lists: np.ndarray | None = None):
        self.ids = ids  # ascending
        self.by_row = np.argsort(rows)
        self.rows = rows[self.by_row]
        n, width = matrix.shape
        self.rising = sorted_lists(matrix) if lists is None else lists
        self.falling = self.rising[:, ::-1]
        self.depths = [0, *(d for d in (FIRST_DEPTH << k for k in range(40)) if d < n), n]
        last, columns = np.maximum(np.array(self.depths) - 1, 0), np.arange(width)[:, None]
        self.lowest = matrix[self.rising[:, last], columns]  # value reached in each list at each depth
        self.highest = matrix[self.falling[:, last], columns]
        self.matrix = matrix
        self.most = int(np.abs(matrix).max(initial=0))

    def search(self, queries: np.ndarray, query_rows: np.ndarray, k: int, best: Best, scored: np.ndarray, deepest: np.ndarray) -> None:
        """Adds this block's share of the k best rows of each query, the query's own row left out, to ``best``; counts the rows
        scored and the depth walked. Ties go to smaller ids."""
        bound = max(self.most, int(np.abs(queries).max(initial=0)), 1)
        kind = np.float32 if bound * bound * queries.shape[1] < 2**24 else np.float64 if bound * bound * queries.shape[1] < 2**53 else np.int64
        matrix, points = self.matrix.astype(kind), queries.astype(kind)
        limits = np.where(points > 0, points, 0) @ self.highest.astype(kind) + np.where(points < 0, points, 0) @ self.lowest.astype(kind)
        at = np.minimum(np.searchsorted(self.rows, query_rows), len(self.rows) - 1)
        own = np.where(self.rows[at] == query_rows, self.by_row[at], -1)
        kth = best.kth()
        for q in range(len(points)):
            if limits[q, 0] < kth[q]:
                continue
            rows, scores, n, depth = self._walk(matrix, points[q], limits[q], int(own[q]), k, kth[q])
            scored[q] += n
            deepest[q] = max(deepest[q], depth)
            best.add(q, self.ids[rows], scores)

    def _walk(self, matrix: np.ndarray, query: np.ndarray, limit: np.ndarray, own: int, k: int, kth: float) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Rows and scores that hold the block's share of the k best, the number of rows scored, and the depth reached."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        fresh = np.ones(n, bool)
        if own >= 0:
            fresh[own] = False
        left, before, rows, scores = int(fresh.sum()), 0, [np.zeros(0, np.int64)], [np.zeros(0, matrix.dtype)]
        for step, depth in enumerate(self.depths[1:], 1):
            met = np.zeros(n, bool)
            met[self.falling[up, before:depth]] = True
            met[self.rising[down, before:depth]] = True
            if not len(up) and not len(down):
                met[:] = True  # every row scores 0
            new = np.flatnonzero(met & fresh)
            fresh[new] = False
            rows.append(new)
            scores.append(matrix[new] @ query)
            left -= len(new)
            every = np.concatenate(scores)
            if len(every) >= k:
                kth = max(kth, np.partition(every, len(every) - k)[len(every) - k])
            if not left or limit[step] < kth:
                break
            before = depth
        good = every >= kth
        return np.concatenate(rows)[good], every[good], len(every), depth


def search_lane(left: pd.DataFrame, right: pd.DataFrame, k: int, figures: bool = False) -> pd.DataFrame:
    """Threshold search of one block of queries in some blocks of vectors, one after another; with ``figures`` what it took."""
    names = ["query_row", "query_id", "vec_id", "score"] if not figures else ["query_row", "query_id", "rows", "scored", "deepest"]
    if left.empty or right.empty:
        return pd.DataFrame(columns=names, dtype=np.int64)
    width = int(max(left["width"].max(), right["width"].max()))
    query_rows, query_ids, points, _ = unpack(right.iloc[0], width)
    best, rows = Best(len(points), k), 0
    scored, deepest = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for _, vectors in left.sort_values("block").iterrows():
        block = SortedLists(*unpack(vectors, width))
        block.search(points, query_rows, k, best, scored, deepest)
        rows += len(block.ids)
    if figures:
        return pd.DataFrame({"query_row": query_rows, "query_id": query_ids, "rows": rows, "scored": scored, "deepest": deepest})
    found = [(int(query_rows[q]), int(query_ids[q]), int(best.ids[q, j]), s) for q in range(len(points)) for j, s in enumerate(best.exact[q])]
    return pd.DataFrame(found, columns=names, dtype=np.int64)


def _lanes(vectors: DataFrame, every: int, id_col: str, vector_col: str):
    """Some blocks of vectors and one block of queries, cogrouped."""
    rows = quantised(vectors, id_col, vector_col)
    total = F.struct(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    n, q = rows.agg(total.alias("t")).first()["t"]
    lanes, q_blocks = -(-max(1, -(-n // BLOCK)) // LANE), max(1, -(-q // QUERIES))
    left = pack(rows, BLOCK, n, True).withColumn("lane", F.floor(F.col("block") / LANE)).withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = pack(rows.where(F.col("vec_id") % every == 0), QUERIES, q, False).withColumnRenamed("block", "queries").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    kind = {"lane": F.col("lane").cast("long"), "queries": F.col("queries").cast("long")}
    return left.withColumns(kind).groupBy("lane", "queries").cogroup(right.withColumns(kind).groupBy("lane", "queries"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Every row but the query's own is a candidate; rows that share an id are each a query and a candidate. Fewer than ``k`` other
    rows give fewer results; shorter vectors count as ending in zeros; other columns aren't read. Some blocks of vectors and one
    block of queries are a group, of bounded size whatever the data; it returns at most ``k`` rows a query, and the merge
    keeps ``k`` before it shuffles.
    """
    found = _lanes(vectors, every, id_col, vector_col).applyInPandas(lambda a, b: search_lane(a, b, k), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def walks(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """What :func:`top_k` took for each query: query_id, rows, scored, deepest. Scores that a few dimensions decide end a walk
    early; among many dimensions of equal weight every row is soon in some list, long before the threshold falls."""
    found = _lanes(vectors, every, id_col, vector_col).applyInPandas(lambda a, b: search_lane(a, b, k, True), WALKS)
    return found.groupBy("query_row", "query_id").agg(F.sum("rows").alias("rows"), F.sum("scored").alias("scored"), F.max("deepest").alias("deepest")).drop("query_row")


ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, v, row_number() OVER () AS row FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  )
), scored AS (
  SELECT q.row, q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 20 = 0 AND q.row <> r.row
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""
