"""Counter-based random numbers as column expressions.

Every draw is a pure function of (seed, stream, counter), so a retried task reproduces its
rows and any SQL engine can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 2147483647  # 2^31 - 1


def _mixed(df: DataFrame, seed: Column, name: str) -> DataFrame:
    """Two rounds of squaring modulo P.

    The steps are separate columns on purpose: each is used twice, and as one expression the
    tree would grow sevenfold per round.  They are declared non-null because a null filter
    that a join infers would be pushed down in exactly that expanded form.
    """
    def mod(c):
        return F.coalesce(c % P, F.lit(0).cast("bigint"))

    df = df.withColumn("_s", F.coalesce(seed, F.lit(0).cast("bigint"))).withColumn("_y", mod(F.col("_s") * 48271))
    df = df.withColumn("_z", mod(F.col("_y") * F.col("_y") + F.col("_s")))
    return df.withColumn(name, mod(F.col("_z") * F.col("_z") + F.col("_y"))).drop("_s", "_y", "_z")


def with_hash31(df: DataFrame, name: str, stream: Column, counter: Column, salt: int = 1) -> DataFrame:
    """Add a uniform integer in [0, 2^31 - 1)."""
    seed = ((counter % P) * 48271 + stream.cast("bigint") * 69621 + F.lit(salt).cast("bigint")) % P
    return _mixed(df, seed, name)


def with_uniform(df: DataFrame, name: str, stream: Column, counter: Column, n: Column, salt: int = 1) -> DataFrame:
    """Add a uniform integer in [0, n); two 31-bit words so that n may exceed 2^31."""
    df = with_hash31(df, "_hi", stream, counter, salt)
    df = _mixed(df, (F.col("_hi") + counter % P) % P, "_lo")
    word = (F.col("_hi") * F.lit(2147483648).cast("bigint") + F.col("_lo")) % n
    return df.withColumn(name, F.coalesce(word, F.lit(0).cast("bigint"))).drop("_hi", "_lo")
