"""Partition schemes: range strings, routing columns to partitions, offsets, overlays."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators.sites import dense_offsets

# Fixed pattern: "start", "start-stop", "start-stop\stride" or "start-stop/stride", 1-based.
RANGE = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*(?:[\\/]\s*(\d+)\s*)?)?$"


def parse_ranges(partitions: DataFrame, length: Column | None = None) -> DataFrame:
    """Range strings -> (part_id, start, stop, stride); a malformed or out-of-bounds range fails."""
    item = partitions.select("*", F.explode(F.split("range_string", ",")).alias("_r")).where(F.trim("_r") != "")
    start = F.regexp_extract("_r", RANGE, 1).try_cast("bigint")
    stop = F.coalesce(F.regexp_extract("_r", RANGE, 2).try_cast("bigint"), start)
    stride = F.coalesce(F.regexp_extract("_r", RANGE, 3).try_cast("bigint"), F.lit(1).cast("bigint"))
    ok = start.isNotNull() & (start >= 1) & (start <= stop) & (stride >= 1)
    if length is not None:
        ok = ok & (stop <= length)
    checked = F.when(ok, start).otherwise(
        F.raise_error(F.concat(F.lit("invalid range: "), F.col("_r"))).cast("bigint"))
    return item.select("part_id", checked.alias("start"), stop.alias("stop"), stride.alias("stride"))


def range_sites(ranges: DataFrame) -> DataFrame:
    """Every column covered by a range; ``sequence`` keeps the generation inside the row."""
    return ranges.select("part_id", F.explode(F.sequence("start", "stop", "stride")).alias("site"))


def cover_counts(ranges: DataFrame, universe: DataFrame) -> DataFrame:
    """Columns not covered exactly once: 0 is missing, more than 1 is ambiguous."""
    hits = range_sites(ranges).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    return universe.select("site").join(hits, "site", "left").select(
        "site", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def segments(ranges: list[tuple[int, int, int, int]]) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
    """Where the set of ranges that reach over a column changes, and the (part, start, stride) of those from there on."""
    begin: dict[int, list] = {}
    end: dict[int, list] = {}
    for k, (p, a, b, stride) in enumerate(ranges):
        begin.setdefault(a, []).append((k, (p, a, stride)))
        end.setdefault(b + 1, []).append(k)
    bounds, over, here = sorted({*begin, *end}), [], {}
    for at in bounds:
        for k in end.get(at, ()):
            here.pop(k)
        here.update(begin.get(at, ()))
        over.append(list(here.values()))
    return bounds, over


def split_by_ranges(sites: DataFrame, ranges: list[tuple[int, int, int, int]], site: str = "site") -> DataFrame:
    """Route columns to partitions by a compiled expression: no shuffle and no exploded map.

    The scheme is a parsed partition file (any number of ranges that the driver can read), the columns may
    be any number.  Its ranges are cut into segments; a column finds its segment by binary search in a constant array, and tries only the
    ranges that reach over it.  Columns covered twice or not at all raise.
    """
    bounds, over = segments(ranges)
    told = {"from": bounds, "over": [[{"p": p, "a": a, "k": k} for p, a, k in here] for here in over]}
    scheme = F.from_json(F.lit(json.dumps(told)), "from ARRAY<BIGINT>, over ARRAY<ARRAY<STRUCT<p: INT, a: BIGINT, k: BIGINT>>>")
    s = F.col(site)
    strides = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    passed = F.aggregate(F.array(*[F.lit(x) for x in strides]), F.lit(0), lambda n, k: F.when(F.get(scheme["from"], n + k - 1) <= s, n + k).otherwise(n))
    hits = F.filter(F.get(scheme["over"], passed - 1), lambda r: (s - r["a"]) % r["k"] == 0)
    found = sites.withColumn("_hits", hits)
    routed = F.when(F.size("_hits") == 1, F.get("_hits", F.lit(0))["p"]).otherwise(F.raise_error(
        F.concat(F.lit("column not covered exactly once: "), s.cast("string"))).cast("int"))
    return found.withColumn("part_id", routed).drop("_hits")


def local_sites(sites: DataFrame) -> DataFrame:
    """0-based index of a column inside its partition (and the way back to the global one)."""
    return dense_offsets(sites, "site", by=("part_id",), name="local_site")


def partition_offsets(lengths: DataFrame) -> DataFrame:
    """Contiguous 1-based range of each partition in part order (partition-file output)."""
    w = Window.orderBy("part_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lengths.select("part_id", "length", F.sum("length").over(w).alias("stop")).select(
        "part_id", (F.col("stop") - F.col("length") + 1).alias("start"), "stop")


def contribution(lengths: DataFrame) -> DataFrame:
    """Share of each partition in the total weight."""
    total = lengths.agg(F.sum("length")).scalar()
    return lengths.select("part_id", (F.col("length") / total).alias("share"))


def row_of(columns: str, taxon: int) -> Column:
    """Sequence of one taxon over an array of (pattern, w) columns, each symbol repeated w times."""
    def symbol(c):
        return F.repeat(F.substring(c["pattern"], taxon + 1, 1), c["w"])

    return F.array_join(F.transform(columns, symbol), "")


class AlignmentView:
    """Overlay on an alignment: nothing is copied, every change is part of the plan."""

    def __init__(self, sites: DataFrame, taxa: list[str], patterns: bool = False):
        self.sites, self.taxa, self.is_patterns = sites, list(taxa), patterns
        self._drop_taxa: set[int] = set()
        self._names: dict[str, str] = {}
        self._drop_sites: DataFrame | None = None
        self._weights: DataFrame | None = None

    def _copy(self) -> AlignmentView:
        v = AlignmentView(self.sites, self.taxa, self.is_patterns)
        v._drop_taxa, v._names = set(self._drop_taxa), dict(self._names)
        v._drop_sites, v._weights = self._drop_sites, self._weights
        return v

    def exclude_taxa(self, ids) -> AlignmentView:
        v = self._copy()
        v._drop_taxa |= set(ids)
        return v

    def rename(self, mapping: dict[str, str]) -> AlignmentView:
        v = self._copy()
        v._names.update(mapping)
        return v

    def exclude_sites(self, sites: DataFrame) -> AlignmentView:
        """``sites(part_id, site)`` vanish through one left-anti join."""
        v = self._copy()
        extra = sites.select("part_id", "site")
        v._drop_sites = extra if self._drop_sites is None else self._drop_sites.unionByName(extra)
        return v

    def weights(self, weights: DataFrame) -> AlignmentView:
        """Replacement weights ``(part_id, site, weight)``; columns without one weigh 1."""
        v = self._copy()
        v._weights = weights.select("part_id", "site", F.col("weight").alias("_w"))
        return v

    @property
    def labels(self) -> list[str]:
        return [self._names.get(t, t) for i, t in enumerate(self.taxa) if i not in self._drop_taxa]

    @property
    def identity(self) -> bool:
        return not (self._drop_taxa or self._names or self._drop_sites is not None or self._weights is not None)

    def to_sites(self) -> DataFrame:
        df = self.sites if "weight" in self.sites.columns else self.sites.withColumn("weight", F.lit(1).cast("bigint"))
        if self._drop_sites is not None:
            df = df.join(self._drop_sites, ["part_id", "site"], "left_anti")
        if self._weights is not None:
            df = df.join(self._weights, ["part_id", "site"], "left").withColumn(
                "weight", F.coalesce("_w", F.lit(1)).cast("bigint")).drop("_w")
        if self._drop_taxa:
            keep = [i for i in range(len(self.taxa)) if i not in self._drop_taxa]
            df = df.withColumn("pattern", F.concat(*[F.substring("pattern", i + 1, 1) for i in keep]))
        return df.select("part_id", "site", "pattern", "weight")

    def total_sites(self) -> DataFrame:
        return self.to_sites().groupBy("part_id").agg(F.sum("weight").alias("sites"))

    def sequence_chunks(self, chunk: int = 1000, uncompress: bool = True) -> DataFrame:
        """Sequences in segments of ``chunk`` columns: (part_id, chunk, taxon, label, segment).

        Whole sequences grow with the alignment, so they are only ever assembled per chunk;
        a writer lays the chunks out as interleaved blocks.
        """
        df = self.to_sites()
        rep = F.col("weight") if uncompress else F.lit(1)
        df = df.where(F.col("weight") > 0).withColumn("chunk", F.floor(F.col("site") / chunk))
        rows = df.groupBy("part_id", "chunk").agg(
            F.array_sort(F.collect_list(F.struct("site", "pattern", rep.cast("int").alias("w")))).alias("_c"))
        labels = self.labels
        entries = F.array(*[F.struct(F.lit(i).alias("taxon"), F.lit(n).alias("label"),
                                     row_of("_c", i).alias("segment")) for i, n in enumerate(labels)])
        return rows.select("part_id", "chunk", F.explode(entries).alias("e")).select("part_id", "chunk", "e.*")
