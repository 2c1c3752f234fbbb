"""Compressed alignments and run results as Parquet.

Patterns are partitioned by ``part_id`` on disk, so loading a few partitions prunes files
and a metadata-only load reads none of the columns.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.sources.alignments import Alignment
from cladeframe.sources.text import exists

VERSION = 2


def write_store(al: Alignment, patterns: DataFrame, path: str, partitions: list | None = None,
                stats: DataFrame | None = None, overwrite: bool = False) -> None:
    spark = patterns.sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    patterns.write.mode(mode).partitionBy("part_id").parquet(f"{path}/patterns")
    if stats is not None:
        stats.write.mode(mode).parquet(f"{path}/stats")
    meta = {"version": VERSION, "labels": al.labels, "partitions": partitions or []}
    spark.createDataFrame([(json.dumps(meta),)], "json STRING").coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["json"])
    if meta["version"] != VERSION:
        raise ValueError(f"unsupported alignment version {meta['version']}")
    return meta


def read_store(spark: SparkSession, path: str, parts: list[int] | None = None) -> Alignment:
    """``parts`` becomes a partition filter: other directories are never listed for reading."""
    meta = read_meta(spark, path)
    p = spark.read.parquet(f"{path}/patterns")
    if parts is not None:
        p = p.where(F.col("part_id").isin(list(parts)))
    p = p.select(F.col("part_id").cast("int").alias("part_id"), "pattern", "weight", "first_site")
    sites = p.select("part_id", F.col("first_site").alias("site"), "pattern", "weight")
    return Alignment(sites, meta["labels"], partitions=meta["partitions"], patterns=p)


class RunStore:
    """Resumable results: each finished batch is one directory with Spark's success marker.

    A batch counts only once it is committed, so a killed run resumes after its last one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self, kind: str, batch: int) -> bool:
        return exists(self.spark, f"{self.path}/{kind}/batch={batch}/_SUCCESS")

    def save(self, kind: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def load(self, kind: str) -> DataFrame | None:
        base = f"{self.path}/{kind}"
        if not exists(self.spark, base):
            return None
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(base)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        ready = [s.getPath().toString() for s in fs.listStatus(p)
                 if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return self.spark.read.option("basePath", base).parquet(*ready).drop("batch") if ready else None

    def forget(self, kind: str, batch: int) -> None:
        """Delete one batch."""
        self._delete(f"{self.path}/{kind}/batch={batch}")

    def clear(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
