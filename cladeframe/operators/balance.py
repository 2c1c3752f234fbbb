"""Distributing alignment columns and searches over processes, as DataFrame operators.

Spark places the data itself; these operators answer the planning questions (how many
columns and how much weight a process would get) for tables of any number of partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators.sites import dense_offsets

REBALANCE_MS = 10000


def site_weight(parts: DataFrame, states: str = "states", cats: str = "cats") -> DataFrame:
    return parts.withColumn("per_site_weight", (F.col(states) * F.col(cats)).cast("double"))


def measured_weight(parts: DataFrame, work: str = "work_ms") -> DataFrame:
    return parts.withColumn("per_site_weight", F.col(work) / F.col("length"))


def equal_chunks(parts: DataFrame, procs: int) -> DataFrame:
    """Every partition cut into ``procs`` equal runs; the last one takes the remainder."""
    chunk = F.floor(F.col("length") / procs)
    e = parts.withColumn("proc", F.explode(F.sequence(F.lit(0), F.lit(procs - 1))))
    return e.select("proc", "part_id", (F.col("start") + F.col("proc") * chunk).alias("start"),
                    F.when(F.col("proc") == procs - 1, F.col("length") - (procs - 1) * chunk).otherwise(chunk).alias("length"))


def even_ranges(parts: DataFrame, procs: int) -> DataFrame:
    """Columns of all partitions laid end to end (shortest partition first) and cut evenly.

    Process p gets columns [floor(p*N/P), floor((p+1)*N/P)), so sizes differ by at most one;
    a partition is split only where a cut falls into it.  The offsets are a two-level
    running sum and each partition is expanded to the processes it touches.
    """
    total = parts.agg(F.sum("length")).scalar()
    ranked = _ranked(parts)
    off = dense_offsets(ranked, "_rank", F.col("length"), name="_off").withColumn("_n", total)
    first = F.floor((F.col("_off") * procs + procs - 1) / F.col("_n"))
    last = F.floor(((F.col("_off") + F.col("length")) * procs - 1) / F.col("_n"))
    # the candidate processes of a partition, widened by one and then tested exactly
    e = off.withColumn("proc", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.lit(procs - 1)))))
    lo = F.floor(F.col("proc") * F.col("_n") / procs)
    hi = F.floor((F.col("proc") + 1) * F.col("_n") / procs)
    a = F.greatest(lo, F.col("_off"))
    b = F.least(hi, F.col("_off") + F.col("length"))
    return e.select(F.col("proc").cast("int").alias("proc"), "part_id", (F.col("start") + a - F.col("_off")).alias("start"),
                    (b - a).alias("length")).where("length > 0")


def weighted_ranges(parts: DataFrame, procs: int) -> DataFrame:
    """As ``even_ranges`` for weighted columns: a column goes where its weight begins.

    A process then carries at most the mean weight plus one column.
    """
    w = F.col("per_site_weight")
    total = parts.agg(F.sum(F.col("length") * w)).scalar()
    ranked = _ranked(parts, w)
    milli = (F.col("length") * F.round(w * 1000)).cast("bigint")
    off = dense_offsets(ranked, "_rank", milli, name="_m").withColumn("_n", total).withColumn("_off", F.col("_m") / 1000.0)
    opt = F.col("_n") / procs
    first = F.floor(F.col("_off") / opt)
    last = F.floor((F.col("_off") + F.col("length") * w) / opt)
    e = off.withColumn("proc", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.lit(procs - 1)))))
    # columns whose starting weight lies in [proc*opt, (proc+1)*opt)
    lo = F.ceil((F.col("proc") * opt - F.col("_off")) / w - 1e-9)
    hi = F.when(F.col("proc") == procs - 1, F.col("length")).otherwise(F.ceil(((F.col("proc") + 1) * opt - F.col("_off")) / w - 1e-9))
    a, b = F.greatest(lo, F.lit(0)), F.least(hi, F.col("length"))
    return e.select(F.col("proc").cast("int").alias("proc"), "part_id", (F.col("start") + a).cast("bigint").alias("start"),
                    (b - a).cast("bigint").alias("length"), w.alias("per_site_weight")).where("length > 0")


def _ranked(parts: DataFrame, weight=None) -> DataFrame:
    """Dense position by (size, id): a count of smaller sizes plus the place among equals."""
    size = F.col("length") if weight is None else F.round(F.col("length") * weight * 1000).cast("bigint")
    df = parts.withColumn("_size", size)
    sizes = df.groupBy("_size").agg(F.count(F.lit(1)).alias("_k"))
    base = dense_offsets(sizes, "_size", F.col("_k"), name="_base").drop("_k")
    placed = dense_offsets(df, "part_id", by=("_size",), name="_in")
    return placed.join(base, "_size").withColumn("_rank", F.col("_base") + F.col("_in")).drop("_size", "_base", "_in")


def round_robin(ids: DataFrame, workers: int, key: str = "search_id") -> DataFrame:
    """Searches dealt to workers in turn."""
    return dense_offsets(ids, key, name="_r").select(key, (F.col("_r") % workers).cast("int").alias("worker"))


def assignment_stats(assignment: DataFrame) -> DataFrame:
    """Smallest and largest share of partitions, columns and weight, and the totals."""
    w = F.col("length") * (F.col("per_site_weight") if "per_site_weight" in assignment.columns else F.lit(1.0))
    per = assignment.groupBy("proc").agg(F.count(F.lit(1)).alias("p"), F.sum("length").alias("s"), F.sum(w).alias("w"))
    return per.agg(F.count(F.lit(1)).alias("cores"), F.min("p").alias("min_parts"), F.max("p").alias("max_parts"),
                   F.min("s").alias("min_sites"), F.max("s").alias("max_sites"), F.min("w").alias("min_weight"),
                   F.max("w").alias("max_weight"), F.sum("p").alias("total_parts"), F.sum("s").alias("total_sites"),
                   F.sum("w").alias("total_weight"))


def work_by_partition(assignment: DataFrame, work: DataFrame) -> DataFrame:
    """Measured work per process spread over its partitions by assigned length."""
    n = assignment.groupBy("proc").agg(F.sum("length").alias("_n"))
    j = assignment.join(n, "proc").join(work.select("proc", "work_ms"), "proc")
    return j.groupBy("part_id").agg(F.sum(F.col("work_ms") / F.col("_n") * F.col("length")).alias("work_ms"))


def needs_rebalance(work: DataFrame) -> DataFrame:
    return work.agg((F.max("work_ms") > REBALANCE_MS).alias("rebalance"))
