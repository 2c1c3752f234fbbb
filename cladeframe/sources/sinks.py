"""Writers.  Large outputs are directories whose parts read in name order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.sites import dense_offsets


def _mode(redo: bool) -> str:
    return "overwrite" if redo else "errorifexists"


def write_phylip(chunks: DataFrame, path: str, redo: bool = False) -> None:
    """Sequence chunks (part_id, chunk, taxon, label, segment) as interleaved PHYLIP.

    Blocks are range-partitioned by position; the header sorts in front of the first block.
    """
    size = chunks.groupBy("taxon").agg(F.sum(F.length("segment")).alias("n"))
    head = size.agg(F.count(F.lit(1)).alias("t"), F.max("n").alias("n")).select(
        F.lit(-1).alias("part_id"), F.lit(0).cast("bigint").alias("chunk"), F.lit(0).alias("taxon"),
        F.concat_ws(" ", "t", "n").alias("value"))
    first = chunks.agg(F.min(F.struct("part_id", "chunk"))).scalar()
    body = chunks.withColumn("_f", first).select("part_id", "chunk", "taxon", F.when(
        (F.col("part_id") == F.col("_f.part_id")) & (F.col("chunk") == F.col("_f.chunk")), F.concat_ws(" ", "label", "segment")).otherwise(F.col("segment")).alias("value"))
    rows = head.unionByName(body.withColumn("chunk", F.col("chunk").cast("bigint")))
    rows.repartitionByRange("part_id", "chunk").sortWithinPartitions("part_id", "chunk", "taxon").select("value").write.mode(
        _mode(redo)).text(path)


def write_replicates(chunks: DataFrame, labels: list[str], path: str, redo: bool = False) -> None:
    """Replicate alignments, one directory per replicate, as interleaved PHYLIP lines."""
    names = F.array(*[F.lit(x) for x in labels])
    size = chunks.where("taxon = 0").groupBy("replicate").agg(F.sum(F.length("segment")).alias("n"),
                                                              F.min(F.struct("part_id", "chunk")).alias("m"))
    head = size.select("replicate", F.lit(-1).alias("part_id"), F.lit(0).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("taxon"),
                       F.concat(F.lit(f"{len(labels)} "), F.col("n").cast("string")).alias("value"))
    body = chunks.join(size.select("replicate", "m"), "replicate").select(
        "replicate", "part_id", "chunk", "taxon", F.when((F.col("m.part_id") == F.col("part_id")) & (F.col("m.chunk") == F.col("chunk")), F.concat_ws(
            " ", F.get(names, F.col("taxon").cast("int")), "segment")).otherwise(F.col("segment")).alias("value"))
    rows = head.unionByName(body)
    rows.repartitionByRange("replicate", "part_id", "chunk").sortWithinPartitions("replicate", "part_id", "chunk", "taxon").select(
        "replicate", "value").write.mode(_mode(redo)).partitionBy("replicate").text(path)


def write_trees(trees: DataFrame, path: str, redo: bool = False) -> None:
    """One Newick text per line, in tree order."""
    trees.repartitionByRange("tree_id").sortWithinPartitions("tree_id").select("newick").write.mode(_mode(redo)).text(path)


def write_rf(pairs: DataFrame, trees: DataFrame, path: str, redo: bool = False, precision: int = 6) -> None:
    """``i j rf rrf`` (0-based tree numbers in the order of their ids, tab-separated), sorted."""
    number = dense_offsets(trees.select("tree_id").distinct(), "tree_id", name="k").select("tree_id", "k")
    rows = pairs.join(number.select(F.col("tree_id").alias("tree_i"), F.col("k").alias("i")), "tree_i").join(
        number.select(F.col("tree_id").alias("tree_j"), F.col("k").alias("j")), "tree_j")
    rows.repartitionByRange("i", "j").sortWithinPartitions("i", "j").select(
        "i", "j", "rf", F.format_string(f"%.{precision}f", F.col("rrf")).alias("rrf")).write.mode(_mode(redo)).option("sep", "\t").csv(path)


def write_ancestral_probs(states: DataFrame, alphabet_states: str, path: str, parts: int, redo: bool = False, precision: int = 6) -> None:
    """``Node [Part] Site State p_A ...``, 1-based, part only with several partitions."""
    local = dense_offsets(states.select("part_id", "site").distinct(), "site", by=("part_id",), name="k")
    j = states.join(local, ["part_id", "site"])
    cols = [F.concat(F.lit("Node"), (F.col("node") + 1).cast("string")).alias("Node")]
    if parts > 1:
        cols.append((F.col("part_id") + 1).alias("Part"))
    cols += [(F.col("k") + 1).alias("Site"), F.col("state").alias("State")]
    cols += [F.format_string(f"%.{precision}f", F.get("probs", F.lit(i))).alias(f"p_{s}") for i, s in enumerate(alphabet_states)]
    j.repartitionByRange("node", "part_id", "k").sortWithinPartitions("node", "part_id", "k").select(*cols).write.mode(
        _mode(redo)).option("sep", "\t").option("header", True).csv(path)


def write_ancestral_states(chunks: DataFrame, path: str, redo: bool = False) -> None:
    """Node name and the sequence over all partitions, as runs of columns in order."""
    chunks.repartitionByRange("node", "part_id", "chunk").sortWithinPartitions("node", "part_id", "chunk").select(
        F.concat(F.lit("Node"), (F.col("node") + 1).cast("string")).alias("node"), "segment").write.mode(_mode(redo)).option(
        "sep", "\t").csv(path)
