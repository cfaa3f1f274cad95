"""Byte-level pre-tokenization as a compiled finite-state transducer, and the vocabulary it feeds.

``byte_bpe`` files split a text into pieces before any merge: contractions, letter runs, number runs and other runs (each
taking one preceding space), and white space that leaves its last character to what follows. The split needs no more
memory than a small state, so it is compiled here to two tables, ``NEXT`` (state x character class -> state) and ``EMIT``
(which piece starts the transition makes certain). A text is run in fixed-size chunks: each chunk is first reduced to a
state map (entry state -> exit state), the maps are composed by a parallel prefix scan, and with its true entry state
every chunk then emits its piece starts. Everything is numpy over the Arrow buffer; no Python string is made.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

# Character classes.
LETTER, ENDS_SHORT, R, V, LL, E, NUMBER, OTHER, QUOTE, SPACE, BLANK, END = range(12)
N_CLASSES = 12
# States, named by the open piece. BLANK* hold white space whose last character may belong to the next piece.
START, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, SPACE_1, BLANK_1, SPACE_N, BLANK_N = range(12)
N_STATES = 12
HERE, BEFORE = 1, 2  # a piece starts at this character; at the one before it


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """The transition and emission tables of the splitter."""
    letters = (LETTER, ENDS_SHORT, R, V, LL, E)
    opens = {c: LETTERS for c in letters} | {NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: QUOTED, SPACE: SPACE_1, BLANK: BLANK_1, END: START}
    nxt = np.zeros((N_STATES, N_CLASSES), np.uint8)
    emit = np.zeros((N_STATES, N_CLASSES), np.uint8)
    for state in range(N_STATES):
        for c, to in opens.items():
            nxt[state, c], emit[state, c] = to, HERE

    def stay(state: int, classes: tuple, to: int, out: int = 0) -> None:
        for c in classes:
            nxt[state, c], emit[state, c] = to, out

    stay(LETTERS, letters, LETTERS)
    stay(NUMBERS, (NUMBER,), NUMBERS)
    stay(OTHERS, (OTHER, QUOTE), OTHERS)
    stay(QUOTED, (OTHER, QUOTE), OTHERS)
    stay(QUOTED, (ENDS_SHORT,), START)
    for c, held, closes in ((R, QUOTED_R, E), (V, QUOTED_V, E), (LL, QUOTED_L, LL)):
        stay(QUOTED, (c,), held)
        for d, to in opens.items():  # the held letter turns out to open a letter run
            stay(held, (d,), to, BEFORE | (0 if d in letters else HERE))
        stay(held, (closes,), START)
    for one, many, keeps_space in ((SPACE_1, SPACE_N, True), (BLANK_1, BLANK_N, False)):
        for state in (one, many):
            out = BEFORE if state == many else 0
            stay(state, (SPACE,), SPACE_N)
            stay(state, (BLANK,), BLANK_N)
            for c in (*letters, NUMBER, OTHER, QUOTE):
                if keeps_space:  # the space joins the run that follows it
                    stay(state, (c,), OTHERS if c == QUOTE else opens[c], out)
                else:
                    stay(state, (c,), opens[c], out | HERE)
    return nxt, emit


NEXT, EMIT = _compile()
_NEXT_FLAT, _EMIT_FLAT = NEXT.ravel().copy(), EMIT.ravel().copy()
CHUNK = 64


def _class_table() -> np.ndarray:
    """Class of every code point: Unicode letters, numbers and white space, as the splitting pattern has them."""
    import unicodedata

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    code = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            table[code[m.start() : m.end()]] = c
    # The library's Unicode tables are older than those of the regex module: it is asked about what Python doesn't know.
    newer = [c for c in np.flatnonzero(table != OTHER).tolist() if unicodedata.category(chr(c)) == "Cn"]
    if newer:
        probe = ByteLevel(add_prefix_space=False)
        for c in newer:
            if len(probe.pre_tokenize_str(f"a{chr(c)}")) > 1 and table[c] == LETTER or len(probe.pre_tokenize_str(f"1{chr(c)}")) > 1 and table[c] == NUMBER:
                table[c] = OTHER
    for chars, c in (("stmd", ENDS_SHORT), ("r", R), ("v", V), ("l", LL), ("e", E), ("'", QUOTE), (" ", SPACE)):
        for x in chars:
            table[ord(x)] = c
    return table


_CLASSES: np.ndarray | None = None


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the characters in UTF-8 bytes, and the class of each."""
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _class_table()
    if not (data & 0x80).any():
        return np.arange(len(data)), _CLASSES[data]
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int64)
    code, wide = lead.copy(), np.flatnonzero(lead >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
        p, x = at[wide], lead[wide]
        two = ((x & 0x1F) << 6) | (padded[p + 1] & 0x3F)
        three = ((x & 0x0F) << 12) | ((padded[p + 1] & 0x3F) << 6) | (padded[p + 2] & 0x3F)
        four = ((x & 0x07) << 18) | ((padded[p + 1] & 0x3F) << 12) | ((padded[p + 2] & 0x3F) << 6) | (padded[p + 3] & 0x3F)
        code[wide] = np.where(x < 0xE0, two, np.where(x < 0xF0, three, four))
    return at, _CLASSES[np.minimum(code, 0x10FFFF)]


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (rows x states) of running ``first`` and then ``then``."""
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan of state maps: row k maps an entry state to the state after chunks 0..k."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def run(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Mask of the characters that start a piece; ``kinds`` are character classes, texts parted by END."""
    n = len(kinds)
    lanes = -(-n // chunk)
    padded = np.full(lanes * chunk, END, np.uint8)
    padded[:n] = kinds
    table = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    for j in range(chunk):
        maps = _NEXT_FLAT[maps * np.uint8(N_CLASSES) + table[j]]
        if j % 8 == 3 and len(maps) > 1 and (maps == maps[0]).all():
            maps = maps[:1]  # every entry state has met in one
    full = np.ascontiguousarray(np.broadcast_to(maps, (N_STATES, lanes)).T)
    after = full[:, START] if len(maps) == 1 else prefix_maps(full)[:, START]
    state = np.concatenate([[START], after[:-1]]).astype(np.uint8)
    out = np.empty((chunk, lanes), np.uint8)
    for j in range(chunk):
        k = state * np.uint8(N_CLASSES) + table[j]
        out[j], state = _EMIT_FLAT[k], _NEXT_FLAT[k]
    flags = out.T.ravel()[:n]
    starts = (flags & HERE) != 0
    starts[:-1] |= (flags[1:] & BEFORE) != 0
    return starts


@dataclass
class Pieces:
    """Pieces of some texts: bytes body[at:at+length]; text k has pieces bounds[k]:bounds[k+1]."""

    data: np.ndarray
    at: np.ndarray
    length: np.ndarray
    bounds: np.ndarray


def split(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """Pieces of the texts data[offsets[k]:offsets[k+1]]."""
    n = len(offsets) - 1
    at, kinds = classes(data)
    bounds = np.searchsorted(at, offsets)  # character index of each text's start
    where = np.arange(len(at)) + np.repeat(np.arange(n), np.diff(bounds))  # each text is followed by one END
    padded = np.full(len(at) + n, END, np.uint8)
    padded[where] = kinds
    begin = at[run(padded)[where]]
    return Pieces(data, begin, np.diff(begin, append=offsets[-1]), np.searchsorted(begin, offsets))


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_MASK = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
WORDS = 4


class PieceSlots:
    """Numbers byte strings, equal ones alike, over many calls: an open-addressing hash table in numpy.

    Exact: the bytes of a piece are compared with those of its slot. Pieces over 32 bytes, and unequal ones under one
    hash, go to a dictionary. Past ``capacity`` slots all are forgotten, so memory is bounded; a subclass keeps what it
    knows of each slot by :meth:`on_new` and :meth:`on_clear`.
    """

    BITS = 22

    def __init__(self, capacity: int = 1_000_000):
        self.capacity = capacity
        self.clear()

    def on_new(self, pieces: list[bytes], first: int) -> None:
        raise NotImplementedError

    def on_clear(self) -> None:
        raise NotImplementedError

    def clear(self) -> None:
        self.table = np.full(1 << self.BITS, -1, np.int32)
        self.used = 0
        self.key = np.zeros(1 << 14, np.uint64)
        self.length = np.zeros(1 << 14, np.int64)
        self.word = np.zeros((WORDS, 1 << 14), np.uint64)
        self.other: dict[bytes, int] = {}
        self.on_clear()

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        at = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        slot = self.table[at]
        again = np.flatnonzero((slot >= 0) & (self.key[slot] != key))
        while len(again):  # linear probing
            at[again] = (at[again] + 1) & ((1 << self.BITS) - 1)
            slot[again] = now = self.table[at[again]]
            again = again[(now >= 0) & (self.key[now] != key[again])]
        return slot

    def _grow(self, n: int) -> None:
        while self.used + n > len(self.key):
            self.key, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.key, self.length))
            self.word = np.concatenate([self.word, np.zeros_like(self.word)], axis=1)

    def _insert(self, key: np.ndarray) -> None:
        """Puts the table's entries for the slots used..used+len(key)."""
        at = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.table[at[todo]] < 0]
            self.table[at[free]] = self.used + free  # of several at one place the last stays
            todo = todo[self.table[at[todo]] != self.used + todo]
            at[todo] = (at[todo] + 1) & ((1 << self.BITS) - 1)

    def look_up(self, p: Pieces) -> np.ndarray:
        """Slot of each piece."""
        if self.used > self.capacity:
            self.clear()
        raw = np.concatenate([p.data, np.zeros(8 * WORDS, np.uint8)])
        view = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
        key = view[p.at]
        key &= _MASK[np.minimum(p.length, 8)]
        words = [(slice(None), key.copy())]
        key ^= p.length.astype(np.uint64) << np.uint64(56)
        key *= _MIX[0]
        key ^= key >> np.uint64(31)
        for w in range(1, WORDS):  # few pieces have a second word of eight bytes
            rows = np.flatnonzero(p.length > 8 * w)
            if not len(rows):
                break
            word = view[p.at[rows] + 8 * w] & _MASK[np.minimum(p.length[rows] - 8 * w, 8)]
            words.append((rows, word))
            mixed = (key[rows] ^ word) * _MIX[w]
            key[rows] = mixed ^ (mixed >> np.uint64(29))
        key *= _MIX[2]
        short = p.length <= 8 * WORDS
        slot = self._find(key)
        new = np.flatnonzero((slot < 0) & short)
        body = raw.tobytes()
        if len(new):
            _, first = np.unique(key[new], return_index=True)
            first = new[first]
            self._grow(len(first))
            mine = slice(self.used, self.used + len(first))
            self.key[mine], self.length[mine] = key[first], p.length[first]
            for w, (rows, word) in enumerate(words):
                whole = word
                if w:
                    whole = np.zeros(len(key), np.uint64)
                    whole[rows] = word
                self.word[w, mine] = whole[first]
            self._insert(key[first])
            self._tell(body, p.at[first].tolist(), p.length[first].tolist())
            slot[new] = self._find(key[new])
        known = np.maximum(slot, 0)
        same = short & (self.length[known] == p.length) & (slot >= 0)
        for w, (rows, word) in enumerate(words):
            same[rows] &= word == self.word[w][known[rows]]
        odd = np.flatnonzero(~same)
        if len(odd):
            spans = list(zip(p.at[odd].tolist(), p.length[odd].tolist(), strict=True))
            fresh = list(dict.fromkeys(x for a, n in spans if (x := body[a : a + n]) not in self.other))
            if fresh:
                self._grow(len(fresh))
                self.length[self.used : self.used + len(fresh)] = -1
                self.other.update(zip(fresh, range(self.used, self.used + len(fresh)), strict=True))
                self.on_new(fresh, self.used)
                self.used += len(fresh)
            slot[odd] = [self.other[body[a : a + n]] for a, n in spans]
        return slot

    def _tell(self, body: bytes, at: list[int], length: list[int]) -> None:
        self.on_new([body[a : a + n] for a, n in zip(at, length, strict=True)], self.used)
        self.used += len(at)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; a null is an empty text."""
    wide = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    body = wide.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of whole texts of at most ``most`` bytes (a longer text is alone)."""
    out, a = [], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


def safe_cuts(data: np.ndarray, most: int) -> list[int]:
    """Where a text may be cut without changing any piece: before a space that follows a character that isn't white space."""
    cuts, a, n = [0], 0, len(data)
    while n - a > most:
        window = data[a + most // 2 : a + most]
        good = np.flatnonzero((window[1:] == 32) & (window[:-1] > 32) & (window[:-1] < 0x80))
        if len(good):
            a = a + most // 2 + int(good[-1]) + 1
        else:
            rest = data[a + most // 2 :]
            good = np.flatnonzero((rest[1:] == 32) & (rest[:-1] > 32) & (rest[:-1] < 0x80))
            if not len(good):
                break
            a = a + most // 2 + int(good[0]) + 1
        cuts.append(a)
    return [*cuts, n]


# --- the vocabulary -----------------------------------------------------------------------------------------------------


def byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as one printable character: printable Latin-1 as itself, others from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file with the library that defines its results."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        self.token_bytes: dict[int, bytes] = {
            i: bytes(back[c] for c in token) for token, i in spec["model"]["vocab"].items() if token.encode() not in self.special
        }
        self.token_bytes |= {i: s for s, i in self.special.items()}

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def has_special(self, body: bytes) -> bool:
        return any(s in body for s in self.special)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
