"""Token ids in a seekable binary format: independent zstandard frames with a trailing seek table.

A file holds one frame per document (its ids as little-endian unsigned 32-bit integers, with the frame's own content
checksum), then a skippable frame that lists the documents' ids, then the seek table of zstandard's public seekable
format: for each frame its compressed and plain size and the low 32 bits of the XXH64 of its plain bytes. A reader takes
the last bytes of the file, then the table, then only the frames it is asked for. Any zstandard tool can also decompress
the whole file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.tokens import library_encoder
from tidewater.workspace import new_path

INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1  # fixed values of the public format
CHECKSUMS = 0x80
END_ID = 2
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class FrameWriter:
    """Writes frames one after the other; keeps 12 bytes a frame and 9 a document for the tables at the end."""

    def __init__(self, stream, level: int = 1):
        self.stream, self.sizes, self.docs = stream, [], []
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        plain = ids.astype("<u4").tobytes()
        frame = self.compressor.compress(plain)
        self.stream.write(frame)
        self.sizes.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.docs.append(doc_id)

    def close(self) -> None:
        ids = np.array([d or 0 for d in self.docs], "<i8").tobytes() + bytes(d is not None for d in self.docs)
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(ids)) + ids)
        table = np.array(self.sizes, "<u4").tobytes() + struct.pack("<IBI", len(self.sizes), CHECKSUMS, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Random access to a file of :class:`FrameWriter`: opens with three small reads and decompresses frames on request."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError("the file has no seek table with checksums")
        table = self._read(size - 9 - 12 * count, 12 * count)
        self.entries = np.frombuffer(table, "<u4").reshape(count, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        index = self._read(int(self.begin[-1]) + 8, 9 * count)
        known = np.frombuffer(index, np.uint8)[8 * count :]
        self.doc_ids = [d if k else None for d, k in zip(np.frombuffer(index[: 8 * count], "<i8").tolist(), known.tolist(), strict=True)]
        self.decompressor = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.entries)

    def frame(self, k: int) -> np.ndarray:
        """Ids of the k-th document, checked against both checksums."""
        packed, plain, checksum = self.entries[k].tolist()
        body = self.decompressor.decompress(self._read(int(self.begin[k]), packed), max_output_size=plain)
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(body, "<u4")

    def document(self, doc_id: int) -> np.ndarray:
        """Ids of the first document of this id; only its frame is decompressed."""
        return self.frame(self.doc_ids.index(doc_id))


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[int, str, int, int]]:
    """Write all documents in ascending id (nulls first) as files of ``folder``; returns (part, uri, documents, ids) of each.

    One range shuffle of the texts orders them; each task then streams its range into one file. A task that is run again
    writes the same bytes to another name and moves them over, so a lost executor leaves no half file. The manifest has
    one row per file, whatever the number of documents.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        uri = f"{folder}/part-{part:06d}.ids.zst"
        fs, name = _open(uri)
        writer = stream = None
        n_docs = n_ids = 0
        for batch in batches:
            if batch.num_rows and writer is None:
                fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                stream = fs.open_output_stream(f"{name}.{attempt}")
                writer = FrameWriter(stream)
            ids, bounds = library_encoder(path).encode(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                writer.add(doc_id, own)
                n_ids += len(own)
            n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(f"{name}.{attempt}", name)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([uri]), pa.array([n_docs]), pa.array([n_ids])], ["part", "uri", "docs", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return sorted(tuple(r) for r in ordered.mapInArrow(write, "part long, uri string, docs long, ids long").collect())


def read_token_files(spark, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """Every document of the files, with the number of ids before it and the CRC-32 of its own."""
    before, rows = 0, []
    for _, uri, _, ids in manifest:
        rows.append((uri, before))
        before += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _open(uri)
                with fs.open_input_file(name) as file:
                    reader, out = FrameReader(file), []
                    for k, doc_id in enumerate(reader.doc_ids):
                        ids = reader.frame(k)
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 4096 or k == len(reader) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = []

    files = spark.createDataFrame(rows, "uri string, start long")
    return files.repartition(max(1, len(rows))).mapInArrow(read, SCHEMA)


def token_files(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write to a new folder of the shared workspace, and read back: one row per document, from the files.

    A null text is empty and has only the end id; a null id sorts first and comes back null; repeated rows are kept, in
    the order of their text; columns other than the two are not read; an empty table gives no file and no row.
    """
    spark = docs.sparkSession
    manifest = write_token_files(docs, new_path(spark, "token-files"), path, end_id, id_col, text_col)
    return read_token_files(spark, manifest)
