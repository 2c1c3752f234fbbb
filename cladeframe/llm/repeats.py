"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the hashes of every ``GRAM`` consecutive words, the smallest in each run that a window of
``length`` words holds, so equal windows have an equal anchor at the same place.  The windows around one anchor that have it as
theirs are its cell; the words from the first to the end of the last are its reach.  Documents are joined on anchors
and on digests of the reach, which compares matches extended to both sides at once, without forming pairs:

1. a cell whose anchor and reach also occur in an earlier document goes as a whole;
2. where an anchor has cells of different reach (a match that begins or ends inside), the windows of one
   representative of each reach are compared one by one;
3. inside one document, windows are compared in place.

Removed windows that overlap add up to maximal repeats.  Keys are two independent 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cladeframe.llm.common import map_slices, stored, utf8, without
from cladeframe.llm.words import WORD_BASE, U, Words, mix, ranges, run_starts, span, sums, words

GRAM = 5
#: Rows without a key are numbered down from the first by a hash of their text, less than the second; keys are smaller than those numbers.
LAST, SPARE = (1 << 63) - 1, 1 << 40


class Text:
    """Words, windows and cells of the texts of a slice."""

    def __init__(self, part: pa.RecordBatch, length: int, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.words: Words = words(*utf8(part.column("text")))
        h = self.words.hashes()
        self.first_sums = sums(h, WORD_BASE[0])
        self.second_sums = sums(self.words.hashes(True), WORD_BASE[1])
        self.at = run_starts(self.words.first, length)
        self.doc = np.searchsorted(self.words.first, self.at, "right") - 1
        self._anchors(h)

    def _anchors(self, h: np.ndarray) -> None:
        g = np.full(len(h), np.iinfo(np.uint64).max, U)
        own = np.arange(max(0, len(h) - self.gram + 1))
        g[own] = span(self.first_sums, own, own + self.gram, WORD_BASE[0])
        # leftmost smallest of the `wide` grams from each word on, by doubling
        wide, best, reach = self.length - self.gram + 1, np.arange(len(h)), 1
        while reach < wide:
            step = min(reach, wide - reach)
            other = best[np.minimum(np.arange(len(h)) + step, len(h) - 1)]
            best = np.where(g[other] < g[best], other, best)
            reach += step
        self.anchor = best[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        self.cell_first = np.flatnonzero(new)
        self.cell_size = np.diff(np.append(self.cell_first, len(self.at)))
        low = self.at[self.cell_first]
        high = low + self.cell_size - 1 + self.length
        place = (self.anchor[self.cell_first] - low).astype(U) * U(1 << 20) + self.cell_size.astype(U)
        self.cell_anchor = g[self.anchor[self.cell_first]].view(np.int64)
        self.cell_reach = mix(span(self.second_sums, low, high, WORD_BASE[1]) ^ mix(place)).view(np.int64)
        self.cell_doc = self.doc[self.cell_first]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of windows given by number."""
        a = self.at[which]
        return (span(self.first_sums, a, a + self.length, WORD_BASE[0]).view(np.int64), span(self.second_sums, a, a + self.length, WORD_BASE[1]).view(np.int64))

    def of_cells(self, which: np.ndarray) -> np.ndarray:
        return ranges(self.cell_first[which], self.cell_size[which])


def distinct(*columns: np.ndarray) -> np.ndarray:
    """Row numbers of the first of equal rows, in sorted order."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order[new]


def _keyed(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for (text of the slice, two hashes)."""
    return mix(mix(mix(doc.astype(U)) ^ a.view(U)) ^ b.view(U))


def _cells(length: int, gram: int):
    def make():
        def work(part: pa.RecordBatch) -> dict:
            t = Text(part, length, gram)
            d = np.asarray(part.column("d"))[t.cell_doc]
            i = distinct(d, t.cell_anchor, t.cell_reach)
            return {"anchor": t.cell_anchor[i], "reach": t.cell_reach[i], "d": d[i]}
        return work
    return make


def _windows(length: int, gram: int):
    def make():
        def work(part: pa.RecordBatch) -> dict:
            t = Text(part, length, gram)
            lists = part.column("anchors")
            n = np.diff(np.asarray(lists.offsets))
            wanted = _keyed(np.repeat(np.arange(len(n)), n), np.asarray(lists.flatten()), np.zeros(n.sum(), np.int64))
            own = _keyed(t.cell_doc, t.cell_anchor, np.zeros(len(t.cell_doc), np.int64))
            w = t.of_cells(np.flatnonzero(np.isin(own, wanted)))
            a, b = t.windows(w)
            d = np.asarray(part.column("d"))[t.doc[w]]
            i = distinct(d, a, b)
            return {"a": a[i], "b": b[i], "d": d[i]}
        return work
    return make


def _cut(length: int, gram: int):
    def make():
        def work(part: pa.RecordBatch) -> dict:
            t = Text(part, length, gram)
            w, docs = t.words, part.num_rows
            lists = part.column("gone")
            n = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            row = np.repeat(np.arange(docs), n)
            whole = np.asarray(flat.field("whole"))
            key = _keyed(row, np.asarray(flat.field("a")), np.asarray(flat.field("b")))
            a, b = t.windows(np.arange(len(t.at)))
            own = _keyed(t.doc, a, b)
            gone = np.isin(own, key[~whole])
            gone[t.of_cells(np.flatnonzero(np.isin(_keyed(t.cell_doc, t.cell_anchor, t.cell_reach), key[whole])))] = True
            later = np.ones(len(own), bool)
            later[np.unique(own, return_index=True)[1]] = False  # the first in its text stays
            at = t.at[gone | later]
            cover = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            covered = np.cumsum(cover)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(covered)])
            return {"n_words": w.counts, "n_removed": total[w.first[1:]] - total[w.first[:-1]], **_kept(w, covered), "removed": _spans(w, covered)}
        return work
    return make


def _kept(w: Words, covered: np.ndarray) -> dict:
    """Kept words of each text joined by one space."""
    stay = np.flatnonzero(~covered)
    size = w.end[stay] - w.start[stay] + 1
    out = np.full(size.sum(), 0x20, np.uint8)
    to = np.cumsum(size) - size
    out[ranges(to, size - 1)] = w.data[ranges(w.start[stay], size - 1)]
    first = np.searchsorted(stay, w.first)
    ends = np.concatenate([to, [size.sum()]])[first]
    texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(ends, ends[1:])]
    return {"kept": pa.array(texts, pa.binary()).cast(pa.string())}


def _spans(w: Words, covered: np.ndarray) -> pa.Array:
    """Removed runs of each text as (first word, number of words), maximal and in order."""
    edge = np.ones(len(covered) + 1, bool)
    edge[1:-1] = covered[1:] != covered[:-1]
    edge[w.first[:-1]] = True
    at = np.flatnonzero(edge[:-1])
    end = np.append(at[1:], len(covered))
    gone = covered[at]
    at, end = at[gone], end[gone]
    doc = np.searchsorted(w.first, at, "right") - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(w.first) - 1))]).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(at - w.first[doc]), pa.array(end - at)], ["first", "words"])
    return pa.ListArray.from_arrays(pa.array(offsets), runs)


def deduplicate(docs: DataFrame, length: int = 20, text: str = "text", key: str = "doc_id", gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """All columns (the text only ``with_text``), with ``n_words``, ``n_removed``, ``kept`` (the kept words, joined by one space) and ``removed``.

    A word goes if a window of ``length`` words covers it that also starts earlier: in a document with a smaller key, or earlier in
    the same one.  ``removed`` holds the maximal removed runs as (first, words), by number of words.  A null text has no
    words.  Rows without a key come after all others, in an order by a hash of their texts, so that no group holds all of them; rows that
    share a key aren't earlier than each other.  Input columns with names of results give way.
    """
    docs = without(docs, ["n_words", "n_removed", "kept", "removed"])
    unkeyed = F.lit(LAST) - F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(SPARE))
    # the last one is never met; with it the column can't be null, so both joins below take the same exchange
    d = F.coalesce(F.col(key).cast("bigint"), unkeyed, F.lit(LAST)).alias("d")
    rest = [f for f in docs.schema.fields if f.name != text]
    wide = docs.select(d, F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*[F.col(f"`{f.name}`") for f in rest]).alias("doc"))
    cells = map_slices(wide.select("d", "text"), "text", "anchor bigint, reach bigint, d bigint", _cells(length, gram))
    reps = cells.groupBy("anchor", "reach").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("n"))
    reps = stored(reps.select("anchor", "d", F.when(F.col("n") > 1, F.col("reach")).alias("reach")), "cells")
    # 1. the same reach in an earlier document; the join is on the reach, the anchor is compared where the text is
    shared = reps.where(F.col("reach").isNotNull()).select(F.col("anchor").alias("a"), F.col("reach").alias("b"), F.col("d").alias("low"))
    again = cells.select(F.col("reach").alias("b"), "d").join(shared, "b").where(F.col("low") < F.col("d")).select("d", F.lit(True).alias("whole"), "a", "b")
    # 2. one anchor, several reaches
    contested = reps.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("anchor")
    asked = reps.select("anchor", "d").join(contested, "anchor").groupBy("d").agg(F.collect_set("anchor").alias("anchors"))
    # both steps that need texts take the same columns from the same exchange by "d", so texts are shuffled once
    found = map_slices(wide.join(asked, "d"), "text", "a bigint, b bigint, d bigint", _windows(length, gram))
    lowest = found.groupBy("a", "b").agg(F.min("d").alias("low"), F.max("d").alias("high")).where(F.col("low") < F.col("high")).select("a", "b", "low")
    later = found.select("a", "d").join(lowest, "a").where(F.col("low") < F.col("d")).select("d", F.lit(False).alias("whole"), "a", "b")
    gone = again.unionByName(later).groupBy("d").agg(F.collect_list(F.struct("whole", "a", "b")).alias("gone"))
    wide = wide.join(gone, "d", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<struct<whole:boolean,a:bigint,b:bigint>>")))
    schema = T.StructType([wide.schema["doc"], *([wide.schema["text"]] if with_text else []), *T._parse_datatype_string("n_words bigint, n_removed bigint, kept string, removed array<struct<first:bigint,words:bigint>>").fields])
    return map_slices(wide, "text", schema, _cut(length, gram)).select("doc.*", *([F.col("text").alias(text)] if with_text else []), "n_words", "n_removed", "kept", "removed")
