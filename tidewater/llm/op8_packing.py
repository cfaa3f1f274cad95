"""Packing by concatenating and cutting.

All documents' ids (each with its end id) form one stream that is cut every ``width`` ids, so only the last sequence is
not full. The stream's order is the order of the input's partitions. Pass one encodes each text once and notes, next to
the ids, how many ids of the same partition precede it; the partitions' totals are prefix-summed to global offsets; pass
two cuts. Neither pass shuffles, and pass two reads rows in any order because every row carries its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.tokens import library_encoder
from tidewater.workspace import written

WIDTH, END_ID = 1024, 0
ENCODED = "part int, doc_id long, before long, doc_tokens long, ids binary"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, opens boolean, closes boolean"
SHORT = 1 << 16  # ids below this are stored in two bytes


def encode(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: ids of every document, and the ids before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = library_encoder(path), 0
        kind = "<u2" if max(encoder.vocab.token_bytes) < SHORT and end_id < SHORT else "<u4"
        for batch in batches:
            n = batch.num_rows
            ids, bounds = encoder.encode(batch.column(1))
            body = [np.append(ids[a:b], np.uint32(end_id)).astype(kind).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            count = np.diff(bounds) + 1
            first = before + np.cumsum(count) - count
            before += int(count.sum())
            part = np.full(n, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), pa.array(first), pa.array(count), pa.array(body, pa.binary())], ["part", "doc_id", "before", "doc_tokens", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, ENCODED)


def cut(encoded: DataFrame, width: int) -> DataFrame:
    """Pass two: global offsets from the partitions' totals (one row per partition reaches the driver), then the cuts."""
    base, total = {}, 0
    for part, tokens in sorted(tuple(r) for r in encoded.groupBy("part").agg(F.sum("doc_tokens")).collect()):
        base[part] = total
        total += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, doc_id, before, n, body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                at = base[part] + before
                ids = np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype("<u4")
                for a in range(-(at % width), n, width):
                    start, end = max(a, 0), min(a + width, n)
                    rows.append((doc_id, start, end - start, zlib.crc32(ids[start:end].tobytes()), n, (at + start) // width, (at + start) % width, start == 0, end == n))
            if rows:
                kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return encoded.mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Boundary records of the packed sequences: one row per piece of a document in a sequence.

    A null text is empty and packs its end id alone; null ids stay null; repeated rows are packed each; other columns are
    not read; an empty table gives no row. ``opens`` and ``closes`` mark the first and last piece of a document. The ids
    are stored once in the shared folder, so a lost executor costs only its own pieces.
    """
    return cut(written(encode(docs, path, end_id, id_col, text_col), "packing"), width)
