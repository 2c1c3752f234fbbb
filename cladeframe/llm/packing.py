"""Concatenate and cut: documents become one stream of token ids, cut into windows of a fixed length.

Pass one tokenises each document once and stores its ids with its start inside its partition.  The prefix sums of the
partitions' totals (one row per partition) give global starts.  Pass two cuts each document at multiples of the window
length and gives a record for each piece.  No document moves between tasks, and only the last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from cladeframe.llm.common import SLICE_BYTES, few_rows, slices, stored, utf8
from cladeframe.llm.words import BYTE_BASE, LOWER, ranges, span, sums, words

#: Up to so many partitions, their starts (16 bytes each) are sent to every task; beyond, they are joined.
FEW_PARTITIONS = 1_000_000
#: Distinct units whose ids a task keeps; the store starts over beyond this number.
KEPT_UNITS = 400_000
WHITE, LETTER, DIGIT, MARK, OTHER = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[0x21:0x7F] = MARK
KINDS[[0x20, *range(0x09, 0x0E)]] = WHITE
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[0x30:0x3A] = DIGIT
KINDS[[0x27, 0x3C]] = OTHER  # contractions and special tokens depend on more than the kind


class Units:
    """Ids of many texts at once by a tokenizer with word ends that lowers case and drops white space.

    Such a tokenizer never joins across white space, nor, inside a chunk of plain letters, digits and marks, across runs of letters
    or of marks and single digits.  So texts are cut into these units with array operations on their bytes, each distinct
    unit goes to the tokenizer once per task, and ids are gathered from its answers.  A chunk with an apostrophe,
    ``<``, a control character or letters other than A-Z and U+00C0 to U+00FF is one unit as it stands.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.end = end
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def cut(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Folded bytes, whether each unit is a whole chunk, starts and ends of units, first unit of each text."""
        kind, data = KINDS[raw], LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        tail = raw[lead + 1]
        good = (tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)
        lead, tail = lead[good], tail[good]
        kind[lead] = kind[lead + 1] = LETTER
        up = tail < 0x9F
        data[lead[up] + 1] = tail[up] + 0x20
        chunk = words(raw, off)
        odd = np.concatenate([[0], np.cumsum(kind == OTHER)])
        whole = odd[chunk.end] > odd[chunk.start]
        for a, b in zip(chunk.start[whole], chunk.end[whole]):
            data[a:b], kind[a:b] = raw[a:b], OTHER
        begin = np.zeros(len(raw), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begin &= kind != WHITE
        begin[chunk.start] = True
        start = np.flatnonzero(begin)
        stop = np.zeros(len(raw) + 1, bool)
        stop[:-1] = begin | (kind == WHITE)
        stop[-1] = True
        stops = np.flatnonzero(stop)
        end = stops[np.searchsorted(stops, start, "right")]
        return data, kind[start] == OTHER, start, end, np.searchsorted(start, off)

    def _ask(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit, and the ids in a row."""
        size, found = np.zeros(len(start), np.int64), []
        plain = np.flatnonzero(~whole)
        order = np.concatenate([plain, np.flatnonzero(whole)])
        for a in range(0, len(plain), 20_000):
            some = plain[a : a + 20_000]
            text = " ".join(data[s:e].tobytes().decode() for s, e in zip(start[some].tolist(), end[some].tolist()))
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer doesn't end each unit with a word end")
            size[some] = np.diff(stops, prepend=0)
            found.append(ids)
        for i in order[len(plain) :]:
            ids = self.tok.encode(data[start[i] : end[i]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
            size[i] = len(ids)
            found.append(np.array(ids, np.uint32))
        flat = np.concatenate([np.zeros(0, np.uint32), *found])
        at = np.zeros(len(start), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return size, flat[ranges(at, size)]

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with the end id after each, and the offset of each text in them."""
        data, whole, start, end, first = self.cut(raw, off)
        h = span(sums(data.astype(np.uint64) + np.uint64(1), BYTE_BASE[0]), start, end, BYTE_BASE[0])
        u, which, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(u) > KEPT_UNITS:
            self._forget()
        pos = np.searchsorted(self.keys, u)
        new = np.flatnonzero(self.keys[np.minimum(pos, len(self.keys) - 1)] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            own = which[new]
            size, flat = self._ask(data, start[own], end[own], whole[own])
            self.at = np.insert(self.at, pos[new], len(self.flat) + np.cumsum(size) - size)
            self.size = np.insert(self.size, pos[new], size)
            self.keys = np.insert(self.keys, pos[new], u[new])
            self.flat = np.concatenate([self.flat, flat])
        row = np.searchsorted(self.keys, u)[inverse]
        size = self.size[row]
        total = np.concatenate([[0], np.cumsum(size)])
        n = len(off) - 1
        offsets = total[first] + np.arange(n + 1)
        out = np.full(offsets[-1], self.end, np.uint32)
        out[np.arange(total[-1]) + np.repeat(np.repeat(np.arange(n), np.diff(first)), size)] = self.flat[ranges(self.at[row], size)]
        return out, offsets

    def long(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text, in stretches between white space."""
        a, found = 0, []
        blank = np.flatnonzero(KINDS[raw] == WHITE)
        while a < len(raw):
            k = int(np.searchsorted(blank, a + SLICE_BYTES, "right")) - 1
            b = int(blank[k]) + 1 if k >= 0 and blank[k] >= a and len(raw) > a + SLICE_BYTES else len(raw)
            found.append(self.ids(raw[a:b], np.array([0, b - a]))[0][:-1])
            a = b
        ids = np.concatenate([*found, np.array([self.end], np.uint32)])
        return ids, np.array([0, len(ids)])


@lru_cache(2)
def units(path: str, end: int) -> Units:
    return Units(path, end)


def tokenised(docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, n_tokens, part, local_start): ids as little-endian unsigned 32-bit integers, ``end`` last."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = pa.schema([("key", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("part", pa.int64()), ("local_start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, own = TaskContext.get().partitionId(), 0, units(path, end)
        for batch in batches:
            for piece in slices(batch, "text"):
                raw, off = utf8(piece.column("text"))
                ids, ends = own.long(raw) if len(raw) > SLICE_BYTES else own.ids(raw, off)
                n = np.diff(ends)
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([piece.column("key"), binary, pa.array(n), pa.array(np.full(len(n), part)), pa.array(at + ends[:-1])], schema=schema)
                at += int(n.sum())

    few_rows(docs.sparkSession)
    return rows.mapInArrow(run, "key bigint, ids binary, n_tokens bigint, part bigint, local_start bigint")


def pack(docs: DataFrame, path: str, length: int = 2048, end: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One record per piece of a document in a sequence.

    Columns: the key, ``start`` (ids of the document before the piece), ``length``, ``ids`` (binary, little-endian unsigned
    32-bit; left out without ``with_ids``), ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``first`` and ``last`` (whether the
    document begins and ends here; the boundary records).  A null or empty text is the end id alone.  Rows that repeat a
    key are documents of their own.  An empty table has no sequence.
    """
    t = stored(tokenised(docs, path, end, key, text), "tokens")
    totals = t.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = stored(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "bases")
    if base.count() <= FEW_PARTITIONS:
        base = F.broadcast(base)
    begin = F.col("base") + F.col("local_start")
    d = t.join(base, "part").select(F.col("key").alias(key), "ids", "n_tokens", begin.alias("g"))
    first = F.floor(F.col("g") / length)
    last = F.floor((F.col("g") + F.col("n_tokens") - 1) / length)

    def piece(s):
        start = F.greatest(s * length - F.col("g"), F.lit(0))
        n = F.least((s + 1) * length - F.col("g"), F.col("n_tokens")) - start
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (n * 4).cast("int"))
        return F.struct(start.alias("start"), n.alias("length"), *([ids.alias("ids")] if with_ids else []), F.crc32(ids).alias("ids_crc32"),
                        s.alias("sequence_id"), (F.col("g") + start - s * length).alias("offset"))

    cut = d.select(key, F.col("n_tokens").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    out = cut.select(key, "doc_tokens", "p.*")
    return out.withColumn("first", F.col("start") == 0).withColumn("last", F.col("start") + F.col("length") == F.col("doc_tokens"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, length) from pieces with ids: at most ``length`` tokens meet in a group."""
    order = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    g = pieces.groupBy("sequence_id").agg(order.alias("p"), F.sum("length").alias("length"))
    return g.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), "length")
