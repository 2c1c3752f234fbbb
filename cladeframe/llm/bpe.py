"""Byte-level BPE encoding and decoding with the vocabulary of a public tokenizer file.

A word's merges run over contiguous arrays: its parts and the rank of each adjacent pair.  The smallest rank (the leftmost
of equals) is looked for again and again, its boundary is deleted and the two neighbouring ranks are looked up anew; many
words are rows of one array and take each step together.  That is quadratic in the length of a word, so a word of more
than ``SHORT`` bytes goes through a heap of ranks over linked parts, which merges in the same order.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from cladeframe.llm.common import map_slices, without
from cladeframe.llm.words import ranges

#: Bytes of a word that are still merged by repeated scanning.
SHORT = 96
#: Words whose ids a task keeps; the store starts over beyond this number.
KEPT_WORDS = 500_000
#: Words merged side by side.
ROWS = 50_000
#: Fixed value: how byte-level BPE of this vocabulary cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 60
IDS = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary: itself if printable, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = j["model"]["vocab"]
        self.pieces: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in j["added_tokens"])]))
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        self.single = [vocab[letters[b]] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(j["model"]["merges"]):
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        n = len(self.ranks)
        order = sorted(self.ranks)
        self.pairs = np.array([a * IDS + b for a, b in order] + [NONE], np.int64)
        self.pair_rank = np.array([self.ranks[p][0] for p in order] + [NONE], np.int64)
        self.merged = np.zeros(n + 1, np.int64)
        for rank, token in self.ranks.values():
            self.merged[rank] = token
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        for t, i in self.special.items():
            self.pieces[i] = t.encode()
        self.piece_size = np.array([len(p) for p in self.pieces])
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.cut = regex.compile(PATTERN)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; ``NONE`` if it doesn't merge."""
        key = left * IDS + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE)

    def scan(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words, as bytes.  Each row holds one word's parts and the ranks of its adjacent pairs."""
        size = np.array([len(w) for w in words])
        wide = int(size.max())
        columns = np.arange(wide)
        bytes_ = np.zeros((len(words), wide), np.uint8)
        bytes_[columns < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        parts = np.array(self.single, np.int64)[bytes_]
        two = self.rank(*(np.array(self.single, np.int64)[x] for x in np.divmod(np.arange(1 << 16), 256)))
        ranks = np.full((len(words), wide), NONE, np.int64)
        ranks[:, :-1] = two[bytes_[:, :-1].astype(np.int64) * 256 + bytes_[:, 1:]]
        ranks[columns + 1 >= size[:, None]] = NONE
        live = np.flatnonzero(ranks.min(1) < NONE)
        done, done_size = parts, size.copy()
        parts, ranks, left = parts[live], ranks[live], size[live]
        while len(live):
            row = np.arange(len(live))
            i = ranks.argmin(1)  # the leftmost of equals
            token = self.merged[ranks[row, i]]
            # the boundary after part i goes: what lies behind moves up by one
            moved = np.minimum(columns + (columns > i[:, None]), wide - 1)
            parts = np.take_along_axis(parts, moved, 1)
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= i[:, None]), wide - 1), 1)
            parts[row, i] = token
            left -= 1
            ranks[row, np.maximum(left - 1, 0)] = NONE
            back = np.flatnonzero(i > 0)
            ranks[back, i[back] - 1] = self.rank(parts[back, i[back] - 1], token[back])
            on = np.flatnonzero(i + 1 < left)
            ranks[on, i[on]] = self.rank(token[on], parts[on, i[on] + 1])
            go = ranks.min(1) < NONE
            if not go.all():
                end = ~go
                done[live[end]], done_size[live[end]] = parts[end], left[end]
                live, parts, ranks, left = live[go], parts[go], ranks[go], left[go]
        flat = done[columns < done_size[:, None]].astype("<u4").tobytes()
        stops = (np.cumsum(done_size) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]

    def _heap(self, text: bytes) -> list[int]:
        parts = [self.single[b] for b in text]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.ranks[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (p := (parts[x], parts[after[x]])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p][0], x, *p))
        return [p for p in parts if p >= 0]

    def learn(self, words: list[str]) -> None:
        """Add words to the store."""
        coded = [w.encode() for w in words]
        for low, high in zip((0, 8, 16, 32), (8, 16, 32, SHORT)):
            some = [k for k, w in enumerate(coded) if low < len(w) <= high]
            for a in range(0, len(some), ROWS):
                for k, ids in zip(some[a : a + ROWS], self.scan([coded[k] for k in some[a : a + ROWS]])):
                    self.known[words[k]] = ids
        for k, w in enumerate(coded):
            if len(w) > SHORT:
                self.known[words[k]] = np.array(self._heap(w), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        cut = [self.words(t) for t in texts]
        parts = [[*map(self.known.get, c)] for c in cut]
        self.learn(list({w for c, p in zip(cut, parts) if None in p for w, ids in zip(c, p) if ids is None}))
        out = [b"".join(map(self.known.__getitem__, c) if None in p else p) for c, p in zip(cut, parts)]
        for w in [w for w in self.known if len(w) > SHORT]:
            del self.known[w]
        return out

    def words(self, text: str) -> list[str]:
        """Words of a text; special tokens are words too."""
        if not any(t in text for t in self.special):
            return self.cut.findall(text)
        self.known.update({t: np.array([i], "<u4").tobytes() for t, i in self.special.items()})
        return [w for x in self.cut_special.split(text) for w in ([x] if x in self.special else self.cut.findall(x))]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Text of each row of ids; bytes that are no UTF-8 become replacement characters."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        size = self.piece_size[flat]
        data = self.piece_bytes[ranges(self.piece_at[flat], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(int)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(docs: DataFrame, path: str, text: str = "text",
               derive: tuple[str, Callable[[bytes, str], tuple]] = ("ids array<int>, decoded string", lambda ids, back: (np.frombuffer(ids, "<u4").astype(np.int32), back))) -> DataFrame:
    """Encode each whole text, decode the ids again; columns of ``docs`` other than the text, then those of ``derive``.

    ``derive`` gives a schema and a function from (ids, decoded text) to its values; by default the ids and the text.  A null
    text counts as empty: no ids, and an empty text back.  Input columns with names of results give way.
    """
    fields = T._parse_datatype_string(derive[0]).fields
    names = [f.name for f in fields]
    docs = docs.withColumnsRenamed({text: "text"}) if text != "text" else docs
    docs = without(docs, [n for n in names if n.lower() != "text"])
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + fields)

    def make():
        c = codec(path)

        def work(part: pa.RecordBatch) -> dict:
            ids = c.encode([t or "" for t in part.column("text").to_pylist()])
            rows = [derive[1](*x) for x in zip(ids, c.decode(ids))]
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}
        return work

    return map_slices(docs, "text", schema, make)
