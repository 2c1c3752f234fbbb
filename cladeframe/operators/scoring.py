"""Information criteria, parameter counts and resource estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Partial-likelihood elements per core for the three planning goals.
ELEMENTS_PER_CORE = {"response": 4000, "balanced": 16000, "throughput": 80000}


def aic(loglh: Column, k: Column) -> Column:
    return 2 * k - 2 * loglh


def aicc(loglh: Column, k: Column, n: Column) -> Column:
    return aic(loglh, k) + 2 * k * (k + 1) / F.greatest(n - k - 1, F.lit(1))


def bic(loglh: Column, k: Column, n: Column) -> Column:
    return F.ln(n) * k - 2 * loglh


def ic_scores(df: DataFrame, loglh: str = "loglh", k: str = "free_params", n: str = "sites") -> DataFrame:
    lo, kk, nn = F.col(loglh), F.col(k), F.col(n)
    return df.withColumns({"aic": aic(lo, kk), "aicc": aicc(lo, kk, nn), "bic": bic(lo, kk, nn)})


def branch_params(branches: Column, parts: Column, linkage: str) -> Column:
    """Free branch lengths: linked B, scaled B + P - 1, unlinked B * P."""
    return {"linked": branches, "scaled": branches + parts - 1, "unlinked": branches * parts}[linkage]


def memory_bytes(taxa: Column, patterns: Column, states: Column, cats: Column, tip_inner: bool = False) -> Column:
    clv = patterns * states * cats
    if tip_inner:
        return (taxa - 2) * clv * 8 + taxa * patterns
    return (2 * taxa - 2) * clv * 8


def cores_for(clv: Column, goal: str) -> Column:
    """Cores for a goal: elements per core, bent towards fewer cores below 8 and more elements above."""
    per = float(ELEMENTS_PER_CORE[goal])
    naive = F.greatest(F.floor(clv / per + 0.5), F.lit(1)).cast("double")
    # the element budget is an integer count
    bent = F.floor(F.when(naive <= 8, per / (4.0 - F.log2(naive))).otherwise(per * (F.log2(naive) - 2.0)))
    return F.greatest(F.floor(clv / bent + 0.5), F.lit(1)).cast("bigint")


def thread_verdict(threads: Column, response: Column) -> Column:
    return F.when(threads > 2 * response, "error").when(threads > response, "warning").otherwise("ok")
