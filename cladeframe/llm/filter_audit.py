"""Filter interaction audit: what each filter takes out in every order in which the filters could stand.

Each document becomes a mask of the filters it fails, and rows of one part and mask are counted.  A part's counts are held
in a decision diagram: one filter a level, the edge taken tells whether a document fails it, equal diagrams are shared and each
node carries the counts of the documents below it.  All orders of the filters are walked by swaps of adjacent levels, and
in each order the path of documents that pass everything gives what every step removes and keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cladeframe.llm.common import stored

WHITE = r"[\x20\x09-\x0D]+"
COLUMNS = "part string, filter_order string, step int, filter string, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


class Diagram:
    """Counts of documents by failure mask, as a diagram whose levels can trade places.

    ``counts`` maps a mask (bit i: filter i failed) to its counts, a tuple of numbers.  Nodes keep their identity in a swap:
    only the level below is made anew, so the nodes above need no change.
    """

    EMPTY = 0

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int):
        self.order = list(range(filters))
        width = len(next(iter(counts.values()), (0,)))
        self.weight = [(0,) * width]  # by node; node 0 has no documents
        self.low, self.high = [0], [0]
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(filters)]
        ends: dict[tuple[int, ...], int] = {}
        below = {}
        for mask, w in counts.items():
            if any(w):
                if w not in ends:
                    ends[w] = self._add(0, 0, w)
                below[mask] = ends[w]
        for level in reversed(range(filters)):
            # what is below here is named by the filters before this level, in the mask's lower bits
            bit = 1 << level
            below = {m: self._node(level, below.get(m, 0), below.get(m | bit, 0)) for m in {m & (bit - 1) for m in below}}
        self.root = below.get(0, self.EMPTY)

    def _add(self, low: int, high: int, weight: tuple[int, ...]) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.weight) - 1

    def _node(self, level: int, low: int, high: int) -> int:
        """The node with these branches, pass and fail; a diagram without documents is the empty one at every level."""
        if low == high == self.EMPTY:
            return self.EMPTY
        if (low, high) not in self.levels[level]:
            self.levels[level][low, high] = self._add(low, high, tuple(a + b for a, b in zip(self.weight[low], self.weight[high])))
        return self.levels[level][low, high]

    def swap(self, level: int) -> None:
        """Let the filters at ``level`` and the next one trade places."""
        nodes = list(self.levels[level].values())
        self.levels[level], self.levels[level + 1] = {}, {}
        for n in nodes:
            a, b = self.low[n], self.high[n]
            self.low[n] = self._node(level + 1, self.low[a], self.low[b])
            self.high[n] = self._node(level + 1, self.high[a], self.high[b])
            self.levels[level][self.low[n], self.high[n]] = n
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) of each step in the present order."""
        n = self.root
        for f in self.order:
            yield f, self.weight[self.low[n]], self.weight[self.high[n]]
            n = self.low[n]


def swaps(n: int) -> Iterator[int]:
    """Places of adjacent swaps that lead through all orders of n things, each order once."""
    if n < 2:
        return
    down = True
    for inner in [*swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + down  # the last thing stands first after a way down, so the others start one place later
        down = not down


def interactions(counts: dict[int, tuple[int, int, int]], names: str) -> list[tuple]:
    """Rows of ``COLUMNS`` without the part: every order of the filters ``names``, every step.

    ``counts`` has (documents, good ones, toxic ones) by mask.
    """
    d = Diagram(counts, len(names))
    walked = [(tuple(d.order), list(d.steps()))]
    for level in swaps(len(names)):
        d.swap(level)
        walked.append((tuple(d.order), list(d.steps())))
    failing, unique, shapley = [0] * len(names), [0] * len(names), [0] * len(names)
    for order, steps in walked:
        failing[order[0]], unique[order[-1]] = steps[0][2][0], steps[-1][2][0]  # nothing is gone before, all else is gone before
        for f, _, removed in steps:
            shapley[f] += removed[0]
    return [("".join(names[f] for f in order), k, names[f], kept[0], removed[0], failing[f] - removed[0], unique[f], removed[1], removed[2], shapley[f])
            for order, steps in walked for k, (f, kept, removed) in enumerate(steps, 1)]


def conditions(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the booleans A to D of its texts: few words, repetitive, many capitals, signs.  Null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("t", t).withColumn("words", F.array_remove(F.split("t", WHITE), ""))
    n, length = F.size("words").cast("bigint"), F.length("t").cast("bigint")
    capitals = length - F.length(F.regexp_replace("t", "[A-Z]", ""))
    return docs.withColumns({"A": n < 50, "B": 100 * F.size(F.array_distinct("words")).cast("bigint") < 65 * n, "C": 100 * capitals > 5 * length, "D": F.col("t").rlike("[#$%&*|]")})


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, mask): filters A to D by text, E if an equal text stands under a smaller key anywhere in the table.

    A row without a key has no smaller one and is none, so it never fails E; rows that repeat a key with its text fail or
    pass together.  Texts are read once; from there on rows have digests.  Copies don't meet in one task: the smallest key of a
    digest is a minimum combined before the shuffle, and rows are joined to it by digest and key.
    """
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text"))
    mask = sum(F.when(F.col(c), 1 << k).otherwise(0) for k, c in enumerate("ABCD"))
    rows = stored(conditions(plain).select("key", "part", mask.alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest")), "masks")
    keyed = rows.where(F.col("key").isNotNull())
    first = keyed.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    told = keyed.join(first, ["digest", "key"], "left").select("key", "part", (F.col("mask") + copy).alias("mask"))
    return told.unionByName(rows.where(F.col("key").isNull()).select("key", "part", "mask"))


def marks(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, good, toxic), one row per key that any label row calls good or toxic."""
    any_of = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    per = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))
    return per.where("good OR toxic")


def audit(rows: DataFrame, labels: DataFrame, names: str = "ABCDE", label_key: str = "doc_id") -> DataFrame:
    """All orders and steps (``COLUMNS``) for each part of ``rows`` (key, part, mask), zeros included; no rows, no parts.

    A part's diagram starts from at most one row per mask, whatever the number of its documents.
    """
    found = rows.join(stored(marks(labels, label_key), "marks"), "key", "left")
    per = found.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = per.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names_ = [c.split()[0] for c in COLUMNS.split(", ")]
        for frame in frames:
            for name, counts in zip(frame["part"], frame["counts"]):
                out = interactions({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counts}, names)
                yield pd.DataFrame([(name, *r) for r in out], columns=names_)

    return parts.mapInPandas(walk, COLUMNS)
