"""BPE encoding and decoding by a traversal of a prefix-sharing trie.

The distinct pieces of a batch are sorted, which is a depth-first walk of their trie: going from one to the next leaves
the nodes below their common prefix and enters those of the rest. Entering a node extends its parent's last-token state
(:mod:`tidewater.llm.lasttoken`) by one byte, so the state of a shared prefix is computed once for all pieces below it. A
piece's encoding is read off the nodes on its path: the last token, then the last token of the prefix before it, and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import pieces as P
from tidewater.llm.lasttoken import LastToken
from tidewater.llm.tokens import Encoder

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TrieEncoder:
    """Encodes sets of pieces; memory is one path of the trie."""

    def __init__(self, vocab: P.Vocabulary):
        self.rules = LastToken(vocab)
        self.size = {i: len(b) for i, b in vocab.token_bytes.items()}

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        path, last, previous = [self.rules.start], [0], b""
        extend, size = self.rules.extend, self.size
        for k in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = pieces[k]
            depth, most = 0, min(len(piece), len(previous))
            while depth < most and piece[depth] == previous[depth]:
                depth += 1
            del path[depth + 1 :], last[depth + 1 :]
            state = path[-1]
            for byte in piece[depth:]:
                state, token, _, _ = extend(state, byte)
                path.append(state)
                last.append(token)
            ids, at = [], len(piece)
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            out[k] = ids[::-1]
            previous = piece
        return out


class Decoder:
    """Ids to bytes by one gather from the vocabulary's concatenated token bytes."""

    def __init__(self, vocab: P.Vocabulary):
        n = max(vocab.token_bytes) + 1
        self.length = np.array([len(vocab.token_bytes.get(i, b"")) for i in range(n)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.body = np.frombuffer(b"".join(vocab.token_bytes.get(i, b"") for i in range(n)), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, and the bounds of each row's."""
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        data = self.body[np.arange(total) + np.repeat(self.start[ids] - (ends - length), length)]
        return data, np.concatenate([[0], ends])[bounds]


class Codec:
    def __init__(self, path: str):
        vocab = P.vocabulary(path)
        self.encoder, self.decoder = Encoder(vocab, TrieEncoder(vocab)), Decoder(vocab)
        self.decimal = np.array([str(i) for i in range(max(vocab.token_bytes) + 1)], object)


_CODECS: dict[str, Codec] = {}
ROWS = 512


def codec(path: str) -> Codec:
    """One per Python worker, kept between its tasks."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every whole text's ids, and of the text decoded from them: one row per input row.

    A null text is empty: no ids, and digests of the empty string. Bytes that are no UTF-8 decode to U+FFFD as the library
    does. Null ids stay null, repeated rows are kept, other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, bounds = own.encoder.encode(batch.column(1))
                data, ends = own.decoder.decode(ids, bounds)
                words, body = own.decimal[ids].tolist(), data.tobytes()
                ids_hash, text_hash = [], []
                for a, b, c, d in zip(bounds[:-1].tolist(), bounds[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    ids_hash.append(hashlib.sha256(",".join(words[a:b]).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(body[c:d].decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(bounds)), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)
