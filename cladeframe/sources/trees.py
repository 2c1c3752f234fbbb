"""Newick files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.sources.text import numbered_records


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """All trees of one file, or of a comma-separated list of files in that order."""
    out, base = None, 0
    for p in path.split(","):
        t = numbered_records(spark, p, ";").select(
            (F.col("line") + base).alias("tree_id"), F.concat(F.trim(F.regexp_replace("value", r"[\r\n]+", " ")), F.lit(";")).alias("newick"))
        out = t if out is None else out.unionByName(t)
        if "," in path:
            base += t.count()
    return out
