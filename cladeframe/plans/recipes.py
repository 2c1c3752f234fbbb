"""Alignments and trees derived from the star-schema tables.

Every recipe covers its whole table.  The unbounded key (order, vector, user-day, document)
becomes the alignment column or the tree id, and the bounded attribute becomes the taxon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.functions.states import DNA_BY_MASK

LINES = list(range(1, 8))
LINE_TAXA = [f"L{i}" for i in LINES]
EVENT_TAXA = ["click", "error", "purchase", "signup", "view"]
PRIORITY_COUNT = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven taxa (line numbers) by one column per order; repeated lines become ambiguity codes.

    ``bit_or`` per (order, line) is a fixed-size buffer, so one shuffle on the order key
    carries at most one row per order and map task.  Partitions are codon positions.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    bit = (F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2)
           .when(F.col("l_linestatus") == "O", 4).otherwise(8))
    wide = li.groupBy(F.col("l_orderkey").alias("site")).agg(
        *[F.bit_or(F.when(F.col("l_linenumber") == k, bit)).alias(f"m{k}") for k in LINES])
    code = [F.substring(F.lit(DNA_BY_MASK), F.coalesce(F.col(f"m{k}"), F.lit(0)) + 1, F.lit(1)) for k in LINES]
    return wide.select((F.col("site") % 3).cast("int").alias("part_id"), "site", F.concat(*code).alias("pattern"))


def order_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``line_sites`` but one column per order of the orders table: orders without lines are all gaps."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"))
    lines = line_sites(spark, sf_dir).select("site", "pattern")
    return keys.join(lines, "site", "left").select(
        (F.col("site") % 3).cast("int").alias("part_id"), "site",
        F.coalesce("pattern", F.lit("-" * len(LINES))).alias("pattern"))


def vector_sites(spark: SparkSession, sf_dir: str, gap_width: float = 0.0) -> DataFrame:
    """64 taxa (dimensions) by one column per vector; partitions are labels.  Narrow: no shuffle."""
    v = table(spark, sf_dir, "embeddings")

    def code(x):
        x = x.cast("double")
        s = F.when(x < -0.084, "A").when(x < 0, "C").when(x < 0.084, "G").otherwise("T")
        return F.when(F.abs(x) < gap_width, "-").otherwise(s) if gap_width else s

    return v.select(F.col("label").alias("part_id"), F.col("vec_id").alias("site"),
                    F.array_join(F.transform("embedding", code), "").alias("pattern"))


def event_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five taxa (event types) by one presence/absence column per user and day."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    wide = e.groupBy((F.col("user_id") * 1000 + day).alias("site")).agg(
        *[F.max(F.when(F.col("event_type") == t, 1)).alias(f"e{i}") for i, t in enumerate(EVENT_TAXA)])
    bits = [F.coalesce(F.col(f"e{i}"), F.lit(0)).cast("string") for i in range(len(EVENT_TAXA))]
    return wide.select(F.lit(0).alias("part_id"), F.col("site"), F.concat(*bits).alias("pattern"))


def document_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("taxon_id"), F.col("source").alias("label"), F.col("text").alias("sequence"))


def customer_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determined (customer, priority) pairs: the customer has a pending order of that priority."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return o.select(F.col("o_custkey").alias("taxon_id"), F.col("o_orderpriority").alias("part_id")).distinct()


def nation_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("taxon_id"), F.col("n_name").alias("label"))


def ladders(counts: DataFrame, tree: str = "tree_id", taxon: str = "taxon_id", n: str = "n") -> DataFrame:
    """Rank taxa inside each tree: (tree, taxon, rank).  A tree has one row per taxon."""
    w = Window.partitionBy(tree).orderBy(F.col(n).desc(), F.col(taxon))
    return counts.select(tree, taxon, n, F.row_number().over(w).alias("rank"))


def ladder_newick(ranked: DataFrame, label: str, tree: str = "tree_id", length: str | None = None) -> DataFrame:
    """Caterpillar Newick per tree: the two best taxa form the innermost pair."""
    tip = F.concat(label, F.lit(":"), F.format_string("%.6f", F.col(length))) if length else F.col(label)
    g = ranked.groupBy(tree).agg(F.array_sort(F.collect_list(F.struct("rank", tip.alias("t")))).alias("_l"))
    inner = F.lit("):0.050000" if length else ")")
    text = F.aggregate(F.slice("_l", F.lit(2), F.size("_l") - 2), F.element_at("_l", 1)["t"],
                       lambda acc, x: F.concat(F.lit("("), acc, F.lit(","), x["t"], inner))
    return g.select(tree, F.concat(F.lit("("), text, F.lit(","), F.element_at("_l", -1)["t"], F.lit(");")).alias("newick"))


def segment_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per (segment x year, nation): 35 trees over 25 taxa at any scale."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    seg = F.col("c_mktsegment")
    g = j.groupBy(seg, "y", F.col("c_nationkey").cast("bigint").alias("taxon_id")).agg(F.count(F.lit(1)).alias("n"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("taxon_id"))
    return _complete(g, [seg, F.col("y")], nations).select(
        F.concat_ws("-", "c_mktsegment", F.col("y").cast("string")).alias("tree_id"), "taxon_id", "n")


def _complete(g: DataFrame, keys, taxa: DataFrame) -> DataFrame:
    """Add the taxa a tree lacks with count 0; the taxon list is a dimension-sized array."""
    names = [c for c in g.columns if c not in ("taxon_id", "n")]
    every = taxa.agg(F.collect_set("taxon_id")).scalar()
    m = g.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("taxon_id", "n"))).alias("_m"))
    return m.withColumn("_all", every).select(*names, F.explode("_all").alias("taxon_id"), "_m").select(
        *names, "taxon_id", F.coalesce(F.element_at("_m", F.col("taxon_id")), F.lit(0)).cast("bigint").alias("n"))


def month_out_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-month-out order counts per nation: 12 similar trees over 25 taxa."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.month("o_orderdate").alias("m"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    months = [F.count(F.when(F.col("m") != k, 1)).alias(f"m{k}") for k in range(1, 13)]
    wide = j.groupBy(F.col("c_nationkey").cast("bigint").alias("taxon_id")).agg(*months)
    wide = nation_taxa(spark, sf_dir).select("taxon_id").join(wide, "taxon_id", "left")
    entries = F.array(*[F.struct(F.lit(k).cast("bigint").alias("tree_id"),
                                 F.coalesce(f"m{k}", F.lit(0)).alias("n")) for k in range(1, 13)])
    return wide.select("taxon_id", F.explode(entries).alias("e")).select("e.tree_id", "taxon_id", "e.n")


def supplier_counts(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """Lines per line number and supplier (or part): one seven-taxon tree per key value."""
    li = table(spark, sf_dir, "lineitem").select(key, "l_linenumber")
    wide = li.groupBy(F.col(key).alias("tree_id")).agg(
        *[F.count(F.when(F.col("l_linenumber") == k, 1)).alias(f"n{k}") for k in LINES])
    entries = F.array(*[F.struct(F.lit(k - 1).cast("bigint").alias("taxon_id"), F.col(f"n{k}").alias("n")) for k in LINES])
    return wide.select("tree_id", F.explode(entries).alias("e")).select("tree_id", "e.taxon_id", "e.n")


def overall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per nation over everything: the reference tree of the segment-year trees."""
    return segment_year_counts(spark, sf_dir).groupBy("taxon_id").agg(F.sum("n").alias("n")).select(
        F.lit(0).cast("bigint").alias("tree_id"), "taxon_id", "n")
