"""Splitter, token counts, token files, packing and codec against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
import regex

from tidewater.llm import op2_token_counts, op7_token_binary, op8_packing, op10_bpe_codec
from tidewater.llm import pieces as P

PATH = P.public_vocabulary()
ODD = ["a", "s", "the", "re", "ve", "ll", " l", "r", "v", "e", "'", " ", "  ", "\n", "\t", "1", "٣", "é", "ß", "漢字", "!", "-", " ", " ", "😀",
       "<|endoftext|>", "x" * 40, "=" * 50, " " * 9, "'s", "Ti", "ing", "tion", "\u0085", "'re"]


def odd_texts(n, seed, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return [*odd_texts(400, 3), "", "word " * 30_000, "x" * 50_000]


@pytest.fixture(scope="module")
def expected(texts):
    return P.vocabulary(PATH).library_ids(texts)


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "n", 1) for k, t in enumerate(texts)] + [(len(texts), None, "n", 1), (0, texts[0], "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int").repartition(3)


def test_splitter_equals_pattern():
    import public_tokenizers

    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [t.replace("<|endoftext|>", "") for t in odd_texts(500, 5, 300)]
    data, offsets = P.buffers(pa.array(texts))
    p = P.split(data, offsets)
    body = data.tobytes()
    for k, t in enumerate(texts):
        got = [body[a : a + n] for a, n in zip(p.at[p.bounds[k] : p.bounds[k + 1]], p.length[p.bounds[k] : p.bounds[k + 1]], strict=True)]
        assert got == [m.encode() for m in pattern.findall(t)]


def test_prefix_scan_is_sequential_composition():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, P.N_STATES, (37, P.N_STATES)).astype(np.uint8)
    state = np.arange(P.N_STATES)
    for k, row in enumerate(P.prefix_maps(maps)):
        state = maps[k][state]
        assert (row == state).all()


def test_safe_cuts_keep_pieces():
    text = "ab  cd 'tis  \n\n x it's 12 " * 2000
    data = np.frombuffer(text.encode(), np.uint8)
    cuts = P.safe_cuts(data, 1000)
    assert len(cuts) > 20
    whole = P.split(data, np.array([0, len(data)])).at.tolist()
    parts = [a + x for a, b in zip(cuts, cuts[1:], strict=False) for x in P.split(data[a:b], np.array([0, b - a])).at.tolist()]
    assert whole == parts


def test_slots_survive_clearing_and_collisions():
    class Table(P.PieceSlots):
        BITS = 6

        def on_clear(self):
            self.names = []

        def on_new(self, pieces, first):
            assert first == len(self.names)
            self.names += pieces

    table = Table(capacity=40)
    for seed in range(20):
        data, offsets = P.buffers(pa.array(odd_texts(3, seed, 8)))
        p = P.split(data, offsets)
        body = data.tobytes()
        slot = table.look_up(p)
        assert [table.names[s] for s in slot] == [body[a : a + n] for a, n in zip(p.at, p.length, strict=True)]


def test_token_counts(docs, texts, expected):
    got = op2_token_counts.token_counts(docs, PATH).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = expected[r.doc_id] if r.doc_id < len(texts) else []
        size = len(texts[r.doc_id].encode()) if r.doc_id < len(texts) else 0
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (size, len(want), len(want) > 1024)


def test_token_files_round_trip(spark, docs, texts, expected):
    got = sorted(tuple(r) for r in op7_token_binary.token_files(docs, PATH).collect())
    want, start = [], 0
    for doc_id in sorted([*range(len(texts) + 1), 0]):
        ids = [*(expected[doc_id] if doc_id < len(texts) else []), 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_reader_decompresses_one_frame(tmp_path):
    with pyarrow.fs.LocalFileSystem().open_output_stream(str(tmp_path / "x")) as out:
        w = op7_token_binary.FrameWriter(out)
        for k in range(50):
            w.add(k * 3, np.arange(k))
        w.add(None, np.arange(5))
        w.close()
    with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f:
        reader = op7_token_binary.FrameReader(f)
        assert reader.document(30).tolist() == list(range(10))
        assert reader.doc_ids[-1] is None and len(reader.frame(50)) == 5
    body = bytearray((tmp_path / "x").read_bytes())
    body[reader.begin[20] + 12] ^= 255
    (tmp_path / "x").write_bytes(bytes(body))
    with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f, pytest.raises(Exception):
        op7_token_binary.FrameReader(f).frame(20)
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(bytes((tmp_path / "x").read_bytes()[: reader.begin[10]]), read_across_frames=True).read()
    assert len(plain) == 4 * sum(range(10))


def test_packing(docs, texts, expected):
    rows = op8_packing.pack(docs, PATH).collect()
    stream: dict[int, dict[int, int]] = {}
    for r in rows:
        ids = [*(expected[r.doc_id] if r.doc_id < len(texts) else []), 0]
        assert r.doc_tokens == len(ids) and 0 < r.length <= 1024
        part = ids[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert (r.opens, r.closes) == (r.start == 0, r.start + r.length == len(ids))
        stream.setdefault(r.sequence_id, {})[r.offset] = r.length
    last = max(stream)
    for s, pieces in stream.items():
        at = 0
        while at in pieces:
            at += pieces[at]
        assert at == sum(pieces.values()) and (at == 1024 or s == last)
    assert sum(r.length for r in rows) == sum(map(len, expected)) + len(expected[0]) + len(texts) + 2


def test_codec(docs, texts, expected):
    for r in op10_bpe_codec.round_trip(docs, PATH).collect():
        want = expected[r.doc_id] if r.doc_id < len(texts) else []
        text = P.vocabulary(PATH).library.decode(want, skip_special_tokens=False)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for f in (op2_token_counts.token_counts, op7_token_binary.token_files, op8_packing.pack, op10_bpe_codec.round_trip):
        assert f(none, PATH).collect() == []
