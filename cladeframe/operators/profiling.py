"""Timer tables: histograms, summaries, rates and the evaluation joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_bin(ratio: Column) -> Column:
    """Bin of a duration over its mean: 100 around one, tenths of 1/x below, of x above.

    Bins 0..99 count 1/ratio from 1 to 10 and beyond, 101..200 the ratio itself.
    """
    inverse = 1.0 / ratio
    below = F.when((ratio <= 0) | (inverse >= 10), 99).otherwise(F.floor((inverse - 1) * 10))
    above = F.when(ratio >= 10, 200).otherwise(F.floor((ratio - 1) * 10) + 101)
    return F.when(F.abs(ratio - 1) < 0.001, 100).when(ratio > 1, above).otherwise(below).cast("int")


def bin_name(b: Column) -> Column:
    """Range label of a bin, three decimals."""
    inv = b / 10.0 + 1
    up = (b - 101) / 10.0 + 1
    # ties go to the even digit, as printf does
    low = F.format_string("%.3f to %.3f", F.bround(1 / (inv + 0.1), 3), F.bround(1 / inv, 3))
    high = F.format_string("%.3f to %.3f", F.bround(up, 3), F.bround(up + 0.1, 3))
    return F.when(b < 100, low).when(b == 100, "0.999 to 1.001").otherwise(high)


def histogram(timings: DataFrame, keys: Sequence[str], value: str = "elapsed", mean: str = "mean") -> DataFrame:
    b = ratio_bin(F.col(value) / F.col(mean)).alias("bin_no")
    g = timings.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("bin", bin_name(F.col("bin_no")))


def timer_stats(timings: DataFrame, keys: Sequence[str], value: str = "ns") -> DataFrame:
    return timings.groupBy(*keys).agg(F.count(F.lit(1)).alias("num"), F.sum(value).alias("nsSum"))


def calls_per_second(timings: DataFrame, timer: str = "timer", at: str = "ts") -> DataFrame:
    """Calls over the whole seconds between a timer's first and last event."""
    g = timings.groupBy(timer).agg(F.count(F.lit(1)).alias("calls"), (F.max(at) - F.min(at)).alias("_span"))
    seconds = F.expr("CAST(extract(DAY FROM _span) * 86400 + extract(HOUR FROM _span) * 3600"
                     " + extract(MINUTE FROM _span) * 60 + extract(SECOND FROM _span) AS DOUBLE)")
    return g.withColumn("_s", seconds).select(timer, F.floor("_s").cast("bigint").alias("secondsPassed"),
                                              F.try_divide("calls", "_s").alias("callsPerSecond"))


def work_by_rank(timings: DataFrame, time: str, rank: str, value: str) -> DataFrame:
    return timings.groupBy(F.col(time).alias("time"), F.col(rank).alias("rank")).agg(F.sum(value).alias("workMs"))


def overall_wide(stats: DataFrame, timers: Sequence[str], keys: Sequence[str] = ("rank", "processor")) -> DataFrame:
    """One row per rank with ``num<T>`` and ``nsSum<T>`` columns; the timer list is given, so one pass."""
    aggs = []
    for t in timers:
        hit = F.col("timer") == t
        aggs += [F.coalesce(F.sum(F.when(hit, F.col("num"))), F.lit(0)).alias(f"num{t}"),
                 F.coalesce(F.sum(F.when(hit, F.col("nsSum"))), F.lit(0)).alias(f"nsSum{t}")]
    return stats.groupBy(*keys).agg(*aggs)


def wide_to_long(wide: DataFrame, timers: Sequence[str], keys: Sequence[str] = ("rank", "processor")) -> DataFrame:
    """Back to one row per timer, with the time per call; both measures move together, no join."""
    entries = F.array(*[F.struct(F.lit(t).alias("timer"), F.col(f"num{t}").alias("num"), F.col(f"nsSum{t}").alias("nsSum")) for t in timers])
    return wide.select(*keys, F.explode(entries).alias("e")).select(
        *keys, "e.timer", "e.num", "e.nsSum", F.try_divide("e.nsSum", "e.num").alias("nsPerCall"))


def across_ranks(long: DataFrame, keys: Sequence[str] = ("timer",)) -> DataFrame:
    return long.groupBy(*keys).agg(
        (F.avg("nsPerCall") / 1e6).alias("msPerCallAvg"), (F.stddev_samp("nsPerCall") / 1e6).alias("msPerCallSD"),
        (F.avg("nsSum") / 1e6).alias("msTotalAvg"), (F.stddev_samp("nsSum") / 1e6).alias("msTotalSD"))


def share_of_runtime(stats: DataFrame, runtimes: DataFrame, key: str = "dataset") -> DataFrame:
    return stats.join(runtimes.select(key, "runtime_ms"), key).withColumn("share", F.col("msTotalAvg") / F.col("runtime_ms"))


def rebalance_eval(work: DataFrame, keys: Sequence[str] = ("time",)) -> DataFrame:
    g = work.groupBy(*keys).agg(F.avg("workMs").alias("meanWorkMs"), F.max("workMs").alias("maxWorkMs"))
    return g.withColumns({"worseThanMeanRel": F.col("maxWorkMs") / F.col("meanWorkMs"),
                          "worseThanMeanAbs": F.col("maxWorkMs") - F.col("meanWorkMs")})


def speedup(runtimes: DataFrame, baseline: str, key: str = "dataset", impl: str = "impl") -> DataFrame:
    """Runtime of every implementation over that of the baseline on the same data."""
    base = runtimes.where(F.col(impl) == baseline).select(key, F.col("runtime").alias("_b"))
    return runtimes.join(base, key).select(key, impl, "runtime", (F.col("runtime") / F.col("_b")).alias("relative"))


def rate_correlation(rates: DataFrame) -> DataFrame:
    return rates.agg(F.corr(1.0 / F.col("callsPerSecond"), F.col("weight")).alias("correlation"))
