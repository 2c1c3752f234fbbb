"""Text records with their position in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_records(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """Non-blank records as ``(line BIGINT, value)``, numbered from 0 in file and offset order.

    Ids are consecutive inside a file split, so a record's number is its distance from the
    first one of its split plus the records of earlier splits.  Only a table with one row
    per split is ordered.
    """
    r = spark.read.option("lineSep", sep) if sep else spark.read
    raw = r.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o"))
    ids = raw.where(F.regexp_replace("value", r"\s", "") != "").withColumn("_m", F.monotonically_increasing_id())
    splits = ids.groupBy("_f", "_o").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_f", "_o").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("_f", "_o", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return ids.join(base, ["_f", "_o"]).select((F.col("_before") + F.col("_m") - F.col("_first")).alias("line"), "value")


def head(spark: SparkSession, path: str, n: int = 4096) -> str:
    """First bytes of a file (or of the first file of a directory) for sniffing."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
        if not names:
            return ""
        p = jvm.org.apache.hadoop.fs.Path(names[0])
    stream = fs.open(p)
    try:
        out = bytearray()
        while len(out) < n:
            b = stream.read()
            if b < 0:
                break
            out.append(b)
        return out.decode("latin-1")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
