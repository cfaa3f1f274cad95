"""Elements of one huge JSON array with their byte spans, by many tasks at once.

The file is read as text whose lines end at commas: Spark's text source splits such a file into byte ranges wherever it lies,
and no line is longer than an element. What a range does depends on whether it begins inside a string and how deep, so a
first pass reduces each range to a map over both cases (exit state, change of depth, commas by depth). Composing the maps
range by range gives every range its true entry state; the second pass then emits the elements that lie in a range whole.
Only the pieces at the ranges' borders are shuffled, by element. Memory is bounded by an element and a batch of lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.workspace import materialize

BLANKS = b" \t\r\n"
RANGE = "path string, start long"
MAPS = f"{RANGE}, size long, file_size long, quotes long, delta0 long, delta1 long, least0 long, least1 long, commas0 map<long,long>, commas1 map<long,long>, lead string"
OPENED = f"{RANGE}, opened long, closed boolean, commas long"
STATES = f"{RANGE}, base long, quoted int, depth long, opened long, position long, error string"
ELEMENTS = "path string, position long, begin long, end long, body string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The text between commas, in order within each byte range of a file."""
    read = spark.read.option("lineSep", ",").text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("file_size"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(the range's other columns, bytes of some of its lines with their commas), in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("value").cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        body = text.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        start = batch.column("start").to_numpy()
        name = batch.column("path").dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(start) != 0) | (np.diff(name) != 0)) + 1).tolist(), batch.num_rows]
        others = [k for k, n in enumerate(batch.schema.names) if n != "value"]
        for a, b in zip(cuts, cuts[1:], strict=False):
            size = np.diff(ends[a : b + 1])
            full = np.full(int(size.sum()) + b - a, 44, np.uint8)
            full[np.arange(int(size.sum())) + np.repeat(np.arange(b - a), size)] = data[ends[a] : ends[b]]
            yield tuple(batch.column(k)[a].as_py() for k in others), full


def _quotes(full: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes. A run of backslashes never crosses a comma."""
    quotes = np.flatnonzero(full == 34)
    after = np.flatnonzero(full[np.maximum(quotes - 1, 0)] == 92)
    if not len(after):
        return quotes
    plain = np.concatenate([[-1], np.flatnonzero(full != 92)])
    run = quotes[after] - 1 - plain[np.searchsorted(plain, quotes[after]) - 1]
    return np.delete(quotes, after[run % 2 == 1])


def _brackets(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero((full == 91) | (full == 93) | (full == 123) | (full == 125))
    return at, np.where((full[at] == 91) | (full[at] == 123), 1, -1)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per range: for both entry cases (outside, inside a string) how the depth changes, its least value after any
    bracket, and how many commas lie outside strings at which depth, all from the depth on entry."""
    held: dict[tuple, dict] = {}
    for (path, start, file_size), full in _ranges(batches):
        r = held.setdefault((path, start), {"size": 0, "file_size": file_size, "quotes": 0, "delta": [0, 0], "least": [None, None], "commas": [{}, {}], "lead": ""})
        if not r["lead"]:
            r["lead"] = full.tobytes()[:4096].lstrip(BLANKS + b"\xef\xbb\xbf")[:1].decode("utf-8", "replace")
        quotes, (at, step), commas = _quotes(full), _brackets(full), np.flatnonzero(full == 44)
        before, commas_before = np.searchsorted(quotes, at), np.searchsorted(quotes, commas)
        for case in (0, 1):
            shift = r["quotes"] + case
            outside = (before + shift) % 2 == 0
            depth = r["delta"][case] + np.concatenate([[0], np.cumsum(step[outside])])
            if len(depth) > 1:
                least = int(depth[1:].min())
                r["least"][case] = least if r["least"][case] is None else min(least, r["least"][case])
            mine = commas[(commas_before + shift) % 2 == 0]
            for level, n in zip(*np.unique(depth[np.searchsorted(at[outside], mine)], return_counts=True), strict=True):
                r["commas"][case][int(level)] = r["commas"][case].get(int(level), 0) + int(n)
            r["delta"][case] = int(depth[-1])
        r["quotes"] += len(quotes)
        r["size"] += len(full)
    rows = [{"path": p, "start": s, "size": r["size"], "file_size": r["file_size"], "quotes": r["quotes"], "delta0": r["delta"][0], "delta1": r["delta"][1], "least0": r["least"][0], "least1": r["least"][1],
             "commas0": list(r["commas"][0].items()), "commas1": list(r["commas"][1].items()), "lead": r["lead"]} for (p, s), r in held.items()]
    if rows:
        counts = pa.map_(pa.int64(), pa.int64())
        kinds = [pa.string(), *[pa.int64()] * 8, counts, counts, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in zip(rows[0], kinds, strict=True)], list(rows[0]))


def _compose(maps: pd.DataFrame) -> list[dict]:
    """Ranges of a file in order, each with its first byte, entry state and map."""
    out, base, quoted, depth = [], 0, 0, 0
    maps = maps.sort_values("start").to_dict("records")
    if maps and maps[0]["file_size"] - sum(r["size"] for r in maps) + 1 == 3:
        base = 3  # a byte order mark, which the text source takes off
    for r in maps:
        least = r[f"least{quoted}"]
        commas = r[f"commas{quoted}"]
        out.append({"path": r["path"], "start": r["start"], "base": base, "quoted": quoted, "depth": depth, "lead": r["lead"],
                    "least": None if least is None or pd.isna(least) else depth + int(least), "commas": {depth + k: n for k, n in (commas.items() if isinstance(commas, dict) else commas or [])}})
        base += r["size"]
        depth, quoted = depth + r[f"delta{quoted}"], (quoted + r["quotes"]) % 2
    return out


def _entries(maps: pd.DataFrame) -> pd.DataFrame:
    """Entry states for the search of the wrapper's array."""
    return pd.DataFrame([{k: r[k] for k in ("path", "start", "base", "quoted", "depth")} for r in _compose(maps)])


def _states(maps: pd.DataFrame, opened: pd.DataFrame | None) -> pd.DataFrame:
    """What the second pass needs of each range that holds part of the array: where the array's inside begins in it (its first
    byte, but for the range that opens the array) and the position of the element under way. Files without an array have an error."""
    rows, level = _compose(maps), 1
    out = lambda r, **x: {k: r[k] for k in ("path", "start", "base", "quoted", "depth")} | {"opened": None, "position": None, "error": None} | x
    first, closed, commas = 0, False, None
    if opened is not None:
        level, opened = 2, opened.sort_values("opened").to_dict("records")
        if not opened:
            return pd.DataFrame([out(rows[0], error="no array of that name")])
        first = next(k for k, r in enumerate(rows) if r["start"] == opened[0]["start"])
        inside, closed, commas = opened[0]["opened"], opened[0]["closed"], opened[0]["commas"]
    else:
        first = next((k for k, r in enumerate(rows) if r["lead"]), None)
        if first is None or rows[first]["lead"] != "[":
            return pd.DataFrame([out(rows[0], error="the top level is not an array")])
        inside = None
    got, position = [], 0
    for k in range(first, len(rows)):
        r = rows[k]
        got.append(out(r, opened=-1 if k == first and inside is None else inside if k == first else r["base"], position=position))
        if closed or (k > first or inside is None) and r["least"] is not None and r["least"] < level:
            return pd.DataFrame(got)
        position += commas if k == first and commas is not None else r["commas"].get(level, 0)
    return pd.DataFrame([out(rows[first], error="the array doesn't end")])


def _find(wrapper: str):
    """Per range the first array that the top-level key ``wrapper`` has in it: where its inside begins, whether it ends in
    the range, and how many commas part its elements there."""
    import json

    pattern = re.compile(re.escape(json.dumps(wrapper, ensure_ascii=False).encode()) + rb"\s*:\s*\[")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}
        for (path, start, _, base, quoted, depth), full in _ranges(batches):
            r = held.setdefault((path, start), {"at": base, "quoted": quoted, "depth": depth, "opened": None, "closed": False, "commas": 0})
            quotes, (at, step) = _quotes(full), _brackets(full)
            outside = (np.searchsorted(quotes, at) + r["quoted"]) % 2 == 0
            at, step = at[outside], step[outside]
            after = r["depth"] + np.cumsum(step)
            lo = 0
            if r["opened"] is None:
                for m in pattern.finditer(full.tobytes()):
                    k = int(np.searchsorted(at, m.end() - 1))
                    if k < len(at) and at[k] == m.end() - 1 and after[k] == 2 and (np.searchsorted(quotes, m.start()) + r["quoted"]) % 2 == 0:
                        r["opened"], lo = r["at"] + m.end(), m.end()
                        break
            if r["opened"] is not None and not r["closed"]:
                ends = np.flatnonzero((at >= lo) & (after == 1))
                last = int(at[ends[0]]) if len(ends) else len(full)
                commas = np.flatnonzero(full[lo:last] == 44) + lo
                level = np.concatenate([[r["depth"]], after])[np.searchsorted(at, commas)]
                r["commas"] += int(((level == 2) & ((np.searchsorted(quotes, commas) + r["quoted"]) % 2 == 0)).sum())
                r["closed"] = bool(len(ends))
            r["at"] += len(full)
            r["quoted"] = (r["quoted"] + len(quotes)) % 2
            r["depth"] = int(after[-1]) if len(after) else r["depth"]
        rows = [(p, s, r["opened"], r["closed"], r["commas"]) for (p, s), r in held.items() if r["opened"] is not None]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], ["path", "start", "opened", "closed", "commas"])

    return run


class _Rows:
    """Rows of elements, handed on in batches of some bytes."""

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.bytes += len(row[4])

    def take(self) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "position": pa.int64(), "begin": pa.int64(), "end": pa.int64(), "body": pa.string(), "whole": pa.bool_()}
        columns = [pa.array([r[k] if k != 4 else r[k].decode("utf-8", "replace") for r in self.rows], kind) for k, kind in enumerate(kinds.values())]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(columns, list(kinds))


def _cut(level: int):
    """Elements at the given depth of each range, and the pieces at its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, r = _Rows(), None, {}

        def end_of_range() -> None:
            if r and r["held"] and not r["done"]:
                body = b"".join(r["held"])
                out.add(now[0], r["position"], r["begin"], r["begin"] + len(body), body, False)

        for (path, start, _, base, quoted, depth, opened, position), full in _ranges(batches):
            if (path, start) != now:
                end_of_range()
                now = (path, start)
                r = {"at": base, "quoted": quoted, "depth": depth, "from": opened, "position": position, "held": [], "begin": 0, "whole": opened < 0 or opened > base, "done": False}
            if not r["done"]:
                quotes, (at, step), commas = _quotes(full), _brackets(full), np.flatnonzero(full == 44)
                outside = (np.searchsorted(quotes, at) + r["quoted"]) % 2 == 0
                at, step = at[outside], step[outside]
                after = r["depth"] + np.cumsum(step)
                if r["from"] < 0 and len(at):  # the file's first bracket
                    r["from"] = r["at"] + int(at[0]) + 1
                lo = max(r["from"] - r["at"], 0) if r["from"] >= 0 else len(full)
                ends = np.flatnonzero((at >= lo) & (after < level))
                last = int(at[ends[0]]) if len(ends) else len(full)
                commas = commas[(commas >= lo) & (commas < last) & ((np.searchsorted(quotes, commas) + r["quoted"]) % 2 == 0)]
                commas = commas[np.concatenate([[r["depth"]], after])[np.searchsorted(at, commas)] == level]
                body, a = full.tobytes(), lo
                for b in [*commas.tolist(), *([last] if len(ends) else [])]:
                    begin = r["begin"] if r["held"] else r["at"] + a
                    piece = b"".join([*r["held"], body[a:b]])
                    if r["whole"]:
                        left = len(piece) - len(piece.lstrip(BLANKS))
                        piece = piece.strip(BLANKS)
                        begin += left
                    if piece or not r["whole"]:
                        out.add(path, r["position"], begin, begin + len(piece), piece, r["whole"])
                    r["held"], r["position"], r["whole"], a = [], r["position"] + 1, True, b + 1
                    if out.bytes > 4 << 20:
                        yield out.take()
                r["done"] = bool(len(ends))
                if not r["done"] and a < len(full):
                    if not r["held"]:
                        r["begin"] = r["at"] + a
                    r["held"].append(body[a:])
                r["quoted"] = (r["quoted"] + len(quotes)) % 2
                r["depth"] = int(after[-1]) if len(after) else r["depth"]
            r["at"] += len(full)
        end_of_range()
        yield out.take()

    return run


def array_elements(spark: SparkSession, path: str, wrapper: str | None = None) -> DataFrame:
    """(path, position, begin, end, body, error) of the elements of JSON array files: bytes [begin, end) of the file are the
    element, positions count from 0. With ``wrapper`` the array is the value of that key of a top-level object.

    What follows the array is ignored. A file without such an array, or whose array doesn't end, gives one row with the error
    and nothing else. An empty array gives no row. Backslashes outside strings aren't JSON; a quote after one counts as escaped.
    One row per byte range is broadcast: its number is that of the scan's splits, which the driver plans anyway.
    """
    text = lines(spark, path)
    maps = materialize(text.mapInArrow(_maps, MAPS))
    level = 1 if wrapper is None else 2
    if wrapper is None:
        states = maps.groupBy("path").applyInPandas(lambda x: _states(x, None).reindex(columns=_names(STATES)), STATES)
    else:
        entries = maps.groupBy("path").applyInPandas(_entries, f"{RANGE}, base long, quoted int, depth long")
        found = text.join(F.broadcast(entries), ["path", "start"]).select("path", "start", "file_size", "base", "quoted", "depth", "value").mapInArrow(_find(wrapper), OPENED)
        states = maps.groupBy("path").cogroup(found.groupBy("path")).applyInPandas(lambda x, y: _states(x, y).reindex(columns=_names(STATES)), STATES)
    states = materialize(states)
    good = states.where("error is null").drop("error")
    placed = text.join(F.broadcast(good), ["path", "start"]).select("path", "start", "file_size", "base", "quoted", "depth", "opened", "position", "value")
    rows = placed.mapInArrow(_cut(level), f"{ELEMENTS}, whole boolean")
    pieces = rows.where("not whole").groupBy("path", "position").agg(F.sort_array(F.collect_list(F.struct("begin", "body"))).alias("p"))
    joined = pieces.select("path", "position", F.col("p")[0]["begin"].alias("at"), F.array_join(F.transform("p", lambda x: x["body"]), "").alias("raw"))
    left = F.octet_length("raw") - F.octet_length(F.regexp_replace("raw", "^[ \\t\\r\\n]+", ""))
    body = F.regexp_replace("raw", "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")
    whole = joined.select("path", "position", (F.col("at") + left).alias("begin"), (F.col("at") + left + F.octet_length(body)).alias("end"), body.alias("body")).where("body <> ''")
    elements = rows.where("whole").drop("whole").unionByName(whole).withColumn("error", F.lit(None).cast("string"))
    none = lambda c: F.lit(None).cast(c)
    failed = states.where("error is not null").select("path", none("long").alias("position"), none("long").alias("begin"), none("long").alias("end"), none("string").alias("body"), "error")
    return elements.unionByName(failed)


def _names(schema: str) -> list[str]:
    return [f.strip().split()[0] for f in schema.split(",")]


def write_array(rows: DataFrame, path: str, order: list[str], body: str = "body") -> None:
    """Rows' JSON as one array over many part files, in total order: the parts, put together by name, are the array. The bytes of
    every element stay as they are, each on a line of its own or more. ``order`` must tell rows apart. An empty table gives ``[]``."""
    place = F.struct(*order)
    ends = rows.agg(F.min(place).alias("first"), F.max(place).alias("last")).first()
    spark = rows.sparkSession
    if ends.first is None:
        spark.range(1).select(F.lit("[]").alias("value")).coalesce(1).write.mode("overwrite").text(path)
        return
    at = lambda end: F.struct(*[F.lit(end[c]).cast(rows.schema[c].dataType).alias(c) for c in order])
    value = F.concat(F.when(place == at(ends.first), "[").otherwise(","), F.col(body), F.when(place == at(ends.last), "]").otherwise(""))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select(value.alias("value")).write.mode("overwrite").text(path)


def keep_elements(elements: DataFrame, keep: DataFrame, path: str) -> None:
    """A copy of an array with only the elements whose (path, position) ``keep`` has, by their original bytes."""
    kept = elements.where("error is null").join(keep.select("path", "position").distinct(), ["path", "position"], "left_semi")
    write_array(kept, path, ["path", "position"])


def write_arrays(rows: DataFrame, path: str, body: str = "body") -> None:
    """Rows' JSON as array files, one per partition, each complete by itself. A partition without rows gives no file or ``[]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            values = []
            for x in batch.column(0).to_pylist():
                values.append(mark + x)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], ["value"])

    rows.select(F.col(body).cast("string")).where(F.col(body).isNotNull()).mapInArrow(run, "value string").write.mode("overwrite").text(path)
