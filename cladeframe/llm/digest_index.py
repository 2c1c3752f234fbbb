"""Exact deduplication against a persistent index of text digests.

The index is a table bucketed and sorted by digest, one row per distinct text with the key of the row that stays.  New
rows lose the digests that the index holds by a sort-merge anti-join (the index side isn't shuffled); what is left is
reduced to one row per digest and appended.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cladeframe.llm.common import stored, without

#: A digest is hot if it holds more than one in this many rows; so there are fewer hot digests than this.
HOT_SHARE = 2048


def normalised(text: str) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: str) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Index in a folder that executors share; ``buckets`` counts only for a new one, an old one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.buckets = self._buckets(path) or buckets
        self.path = f"{path}/b{self.buckets}"
        self.name = "digests_" + uuid.uuid4().hex
        self._open()

    def _buckets(self, path: str) -> int:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return next((int(m[1]) for n in names if (m := re.fullmatch(r"b(\d+)", n))), 0)

    def _open(self) -> None:
        self.spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
                       f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, lowest: DataFrame) -> None:
        """Append (digest, keep_id) rows, one for each digest, whose digest is not there yet.

        A repeated call with the same rows appends nothing, so a job that broke off can be run again.
        """
        new = lowest.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        (new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))


def deduplicate(docs: DataFrame, index: DigestIndex, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Add the rows to the index; every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``;
    without the text, unless ``with_text``.

    Of equal texts of one call the smallest key stays (of rows that repeat it, one); null keys come after all others.  A
    text that the index already holds stays with its earlier key, and all new rows with it go.  ``group_size`` counts
    the rows of this call.  Input columns with the names of results give way.
    """
    docs = without(docs, ["keep_id", "group_size", "kept", "text_sha256"])
    others = [F.col(f"`{c}`") for c in docs.columns if with_text or c != text]
    rows = stored(docs.select(F.struct(*others).alias("doc"), F.col(f"`{key}`").cast("bigint").alias("key"), digest(text).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    stays = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row")))
    groups = rows.groupBy("digest").agg(stays.alias("stays"), F.count(F.lit(1)).alias("group_size"))
    held = index.table().select("digest", F.col("keep_id").alias("before"), F.lit(True).alias("old"))
    groups = groups.join(held.hint("merge"), "digest", "left").select(
        "digest", "group_size", F.when(F.col("old"), F.col("before")).otherwise(F.col("stays.key")).alias("keep_id"), F.when(F.col("old").isNull(), F.col("stays.row")).alias("stays"))
    groups = stored(groups, "groups")
    index.add(groups.where(F.col("stays").isNotNull()).select("digest", "keep_id"))
    # fewer than HOT_SHARE groups are hot, so they are sent to every task; rows of all others meet their group by a join
    total = rows.count()
    is_hot = F.col("group_size") * HOT_SHARE > total
    near = rows.join(F.broadcast(groups.where(is_hot)), "digest", "left")
    far = near.where(F.col("group_size").isNull()).select(rows.columns).join(groups.where(~is_hot), "digest")
    out = near.where(F.col("group_size").isNotNull()).unionByName(far)
    return out.select("doc.*", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("stays"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
