"""Resampling alignment columns with replacement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.rng import with_uniform
from cladeframe.operators.partitions import row_of
from cladeframe.operators.sites import dense_offsets


def draw_weights(sites: DataFrame, replicates: int, salt: int = 1) -> DataFrame:
    """As many draws per partition as it has columns -> (replicate, part_id, pattern, weight).

    Column i of every partition owns draw i, so draws are generated where the columns are
    and no counter sequence is ever built.  Equal draws are counted before the join that
    turns a column index into its pattern; that join is on a unique, evenly spread key.
    """
    dense = dense_offsets(sites.select("part_id", "site", "pattern"), "site", by=("part_id",), name="_i")
    size = sites.groupBy("part_id").agg(F.count(F.lit(1)).alias("_n"))
    reps = dense.select("part_id", "_i").join(size, "part_id").withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    stream = F.col("replicate").cast("bigint") * 1000 + F.col("part_id")
    draws = with_uniform(reps, "_u", stream, F.col("_i"), F.col("_n"), salt).select("replicate", "part_id", F.col("_u").alias("_i"))
    counted = draws.groupBy("replicate", "part_id", "_i").agg(F.count(F.lit(1)).alias("_k"))
    hit = counted.join(dense.select("part_id", "_i", "pattern"), ["part_id", "_i"])
    return hit.groupBy("replicate", "part_id", "pattern").agg(F.sum("_k").alias("weight"))


#: Columns by their first position in a unit, and units in a group.  Fixed, so that draws depend on data and seed only.
UNIT, GROUP = 16_384, 4_096


def multinomial_weights(patterns: DataFrame, replicates: int, seed: int = 1, first: int = 0) -> DataFrame:
    """The same distribution, drawn over patterns instead of columns.

    A multinomial splits exactly into one over groups of units, one over the units of each group and one inside each
    unit, so the cost follows the number of patterns, whatever they weigh, and every draw is a bounded task of its own.
    Generators are seeded by (seed, level, part, number, replicate): retries, other layouts and other batches repeat the draws.
    Replicates are numbered from 0 in the result; the first of them is number ``first`` of all.
    """
    keyed = patterns.select("part_id", "pattern", "weight", "first_site", F.floor(F.col("first_site") / UNIT).alias("unit"))
    units = keyed.groupBy("part_id", "unit").agg(F.sum("weight").alias("weight")).withColumn("grp", F.floor(F.col("unit") / GROUP))
    groups = units.groupBy("part_id", "grp").agg(F.sum("weight").alias("weight"))

    def shares(level: int, n: np.ndarray, pdf: pd.DataFrame, name: str, part: int, number: int) -> pd.DataFrame:
        """Draws n[r] out of the weights of the rows, for every replicate r; rows that none hits are left out."""
        w = pdf.weight.to_numpy(dtype=np.float64)
        k = np.stack([np.random.default_rng([seed, level, part, number, first + r]).multinomial(n[r], w / w.sum()) for r in range(replicates)])
        r, i = np.nonzero(k)
        return pd.DataFrame({"part_id": part, name: pdf[name].to_numpy()[i], "replicate": r, "n": k[r, i]})

    def over_groups(key, pdf):
        pdf = pdf.sort_values("grp")
        return shares(0, np.full(replicates, pdf.weight.sum()), pdf, "grp", int(key[0]), 0)

    def within(level, name, order):
        def draw(key, pdf, quota):
            n = np.zeros(replicates, np.int64)
            n[quota.replicate.to_numpy()] = quota.n.to_numpy()
            return shares(level, n, pdf.sort_values(order), name, int(key[0]), int(key[1]))
        return draw

    quota = groups.groupBy("part_id").applyInPandas(over_groups, "part_id INT, grp BIGINT, replicate INT, n BIGINT")
    quota = units.groupBy("part_id", "grp").cogroup(quota.groupBy("part_id", "grp")).applyInPandas(
        within(1, "unit", "unit"), "part_id INT, unit BIGINT, replicate INT, n BIGINT")
    drawn = keyed.groupBy("part_id", "unit").cogroup(quota.groupBy("part_id", "unit")).applyInPandas(
        within(2, "pattern", "first_site"), "part_id INT, pattern STRING, replicate INT, n BIGINT")
    return drawn.select("replicate", "part_id", "pattern", F.col("n").alias("weight"))


def _cut(df: DataFrame, size: int, name: str) -> DataFrame:
    """Runs of output columns (``start`` to ``stop``) cut at multiples of ``size``, with the number of the piece."""
    cut = df.withColumn(name, F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    return cut.withColumn("start", F.greatest("start", F.col(name) * size)).withColumn("stop", F.least("stop", (F.col(name) + 1) * size))


def replicate_chunks(weights: DataFrame, patterns: DataFrame, n_taxa: int, chunk: int = 1000) -> DataFrame:
    """Replicate alignments in segments: (replicate, part_id, chunk, taxon, segment).

    Drawn columns stand in the order of their pattern's first column and are cut every ``chunk`` of them, so a pattern
    that fills most of an alignment covers many chunks.  Runs are cut coarsely first and dealt out before they are cut finely.
    """
    j = weights.where("weight > 0").join(patterns.select("part_id", "pattern", "first_site"), ["part_id", "pattern"])
    j = dense_offsets(j, "first_site", F.col("weight"), by=("replicate", "part_id"), name="start")
    j = j.withColumn("stop", F.col("start") + F.col("weight")).drop("weight")
    keys = ["replicate", "part_id", "_run"]
    pieces = _cut(_cut(j, chunk * 4096, "_run").repartition(*keys), chunk, "chunk")
    g = pieces.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(
        F.struct("start", "pattern", (F.col("stop") - F.col("start")).cast("int").alias("w")))).alias("_c"))
    entries = F.array(*[F.struct(F.lit(i).cast("bigint").alias("taxon"), row_of("_c", i).alias("segment"))
                        for i in range(n_taxa)])
    return g.select("replicate", "part_id", "chunk", F.explode(entries).alias("e")).select(
        "replicate", "part_id", "chunk", "e.*")
