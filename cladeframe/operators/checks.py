"""Validation of alignments, trees and option combinations as queries.

Each check returns the offending rows, so an empty result means the check passed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.states import Alphabet
from cladeframe.session import parallelism

# Characters that Newick reserves and names therefore may not contain.
RESERVED = "(),;:' \t\n"
RESERVED_CLASS = r"[(),;:' \t\n]"
MIN_TAXA = 4
# Named groups of safety checks.
SAFETY = {
    "perf": ("perf_threads",),
    "msa": ("msa_names", "msa_dups", "msa_allgaps"),
    "model": ("model_zero_freqs", "model_invalid_freqs", "model_lg4_freqs", "model_overfit"),
}


def safety_checks(force: str | None = None) -> set[str]:
    """Active checks after clearing the comma-separated names or groups in ``force``."""
    active = {c for group in SAFETY.values() for c in group}
    if force is None:
        return active
    for name in filter(None, force.replace(" ", "").split(",")):
        if name == "all":
            return set()
        if name in SAFETY:
            active -= set(SAFETY[name])
        elif name in {c for g in SAFETY.values() for c in g}:
            active.discard(name)
        else:
            raise ValueError(f"unknown safety check: {name}")
    return active


def too_few_taxa(taxa: DataFrame) -> DataFrame:
    return taxa.agg(F.count(F.lit(1)).alias("n_taxa")).where(F.col("n_taxa") < MIN_TAXA)


def unequal_lengths(sequences: DataFrame, key: str = "aln_id") -> DataFrame:
    """Alignments whose sequences differ in length."""
    n = F.length("sequence")
    return sequences.groupBy(key).agg(F.min(n).alias("min_length"), F.max(n).alias("max_length")).where(
        "min_length <> max_length")


def later_copies(df: DataFrame, key_id: str, *same: str) -> DataFrame:
    """Rows that equal an earlier row in ``same``, with the id of the first one.

    The first id is a map-side combined minimum; the join back carries only ids and keys,
    and a hot key is a skewed left side that adaptive execution splits.
    """
    first = df.groupBy(*same).agg(F.min(key_id).alias("first_id"))
    return df.select(key_id, *same).join(first, list(same)).where(F.col(key_id) > F.col("first_id")).select(
        key_id, "first_id")


def duplicate_names(taxa: DataFrame, key_id: str = "taxon_id", label: str = "label") -> DataFrame:
    return later_copies(taxa, key_id, label)


def duplicate_sequences(sequences: DataFrame, key_id: str = "taxon_id", text: str = "sequence",
                        skip: DataFrame | None = None) -> DataFrame:
    """Later copies of identical whole sequences; taxa in ``skip`` (gap-only) are left out.

    Sequences are compared by SHA-256 and length, so the shuffle moves 32-byte keys.
    """
    df = sequences if skip is None else sequences.join(skip.select(key_id), key_id, "left_anti")
    keyed = df.select(key_id, F.unhex(F.sha2(F.col(text), 256)).alias("_h"), F.length(text).alias("_n"))
    return later_copies(keyed, key_id, "_h", "_n")


def invalid_names(taxa: DataFrame, label: str = "label") -> DataFrame:
    return taxa.where(F.col(label).rlike(RESERVED_CLASS)).withColumn(
        "fixed_label", F.regexp_replace(label, RESERVED_CLASS, "_"))


def invalid_characters(sequences: DataFrame, alphabet: Alphabet, key_id: str = "taxon_id",
                       text: str = "sequence") -> DataFrame:
    """Every symbol outside the alphabet with its 1-based position in the whole sequence."""
    allowed = alphabet.symbols()
    bad_only = sequences.where(F.translate(text, allowed, "") != "")
    chars = bad_only.select(key_id, F.posexplode(F.split(text, "")).alias("_i", "symbol"))
    return chars.where(~F.col("symbol").isin(*allowed) & (F.col("symbol") != "")).select(
        key_id, (F.col("_i") + 1).cast("bigint").alias("position"), "symbol")


def invalid_character_counts(sequences: DataFrame, alphabet: Alphabet, key_id: str = "taxon_id",
                             text: str = "sequence") -> DataFrame:
    return invalid_characters(sequences, alphabet, key_id, text).groupBy(key_id, "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position"))


def invalid_cells(sites: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Symbols outside the alphabet in a column-wise alignment: (part_id, site, taxon_id, symbol).

    Only columns that hold one are exploded.
    """
    allowed = alphabet.symbols()
    bad = sites.where(F.translate("pattern", allowed, "") != "")
    cells = bad.select("part_id", "site", F.posexplode(F.split("pattern", "")).alias("taxon_id", "symbol"))
    return cells.where(~F.col("symbol").isin(*allowed))


def identical_taxa(patterns: DataFrame, n_taxa: int) -> list[tuple[int, int]]:
    """(first, later) pairs of taxa with equal sequences, from the compressed columns.

    A fingerprint per taxon (an XOR of cell hashes, one row per taxon) proposes pairs; every
    proposal is then verified on all columns, so the answer is exact.
    """
    cells = patterns.select("part_id", "pattern", F.posexplode(F.split("pattern", "")).alias("taxon_id", "s"))
    h = F.xxhash64("part_id", "pattern", "s")
    rows = cells.groupBy("taxon_id").agg(F.bit_xor(h).alias("h")).collect()
    first: dict[int, int] = {}
    pairs = []
    for r in sorted(rows, key=lambda r: r["taxon_id"]):
        if r["h"] in first:
            pairs.append((first[r["h"]], r["taxon_id"]))
        first.setdefault(r["h"], r["taxon_id"])
    sure = []
    for i in range(0, len(pairs), 500):
        part = pairs[i:i + 500]
        diff = patterns.agg(*[F.max(F.substring("pattern", a + 1, 1) != F.substring("pattern", b + 1, 1)).alias(f"d{k}")
                              for k, (a, b) in enumerate(part)]).first()
        sure += [p for k, p in enumerate(part) if not diff[k]]
    return sure


def undetermined_taxa(patterns: DataFrame, alphabets: dict[int, Alphabet]) -> list[int]:
    """Taxa whose every cell is a gap, over all partitions."""
    cells = patterns.select("part_id", F.posexplode(F.split("pattern", "")).alias("taxon_id", "s"))
    known = F.lit(False)
    for p, a in alphabets.items():
        gaps = [c for c, m in a.masks.items() if m == a.full]
        known = known | ((F.col("part_id") == p) & ~F.col("s").isin(gaps))
    rows = cells.groupBy("taxon_id").agg(F.max(known).alias("k")).where(~F.col("k")).collect()
    return sorted(r["taxon_id"] for r in rows)


def gap_only_taxa(presence: DataFrame, taxa: DataFrame, taxon: str = "taxon_id") -> DataFrame:
    """Taxa undetermined in every partition; ``presence`` has the determined (taxon, part) pairs."""
    return taxa.select(taxon).join(presence.select(taxon), taxon, "left_anti")


def presence_matrix(presence: DataFrame, taxa: DataFrame, parts: DataFrame, taxon: str = "taxon_id", part: str = "part_id") -> DataFrame:
    """One 0/1 string per taxon, a digit for each partition of ``parts`` in order; no partition is left out.

    The list of partitions is as long as one taxon's result.
    """
    have = presence.groupBy(taxon).agg(F.collect_set(part).alias("_have"))
    every = parts.agg(F.sort_array(F.collect_set(part)).alias("_all")).scalar()
    rows = taxa.select(taxon).join(have, taxon, "left").withColumn("_all", every)
    none = F.col("_have").isNull()
    bit = F.transform("_all", lambda p: F.when(none, "0").when(F.array_contains("_have", p), "1").otherwise("0"))
    return rows.select(taxon, F.array_join(bit, "").alias("presence"))


#: Tips of the trees that one task compares with the taxon list.
TIPS_A_TASK = 1 << 20


def tree_taxa_mismatch(tips: DataFrame, taxa: DataFrame, tree: str = "tree_id", once: bool = False) -> DataFrame:
    """Duplicate, unknown and missing tips of every tree, as (tree, label, problem); with ``once`` a tip may come in several rows.

    The taxon list, as long as one alignment column, is compared with each tree's own list.  Trees are dealt to as many tasks as
    there are tips before lists are made, so that what a task holds doesn't grow with the number of trees.
    """
    n = max(parallelism(tips.sparkSession), math.ceil(tips.count() / TIPS_A_TASK))
    collect = F.collect_set if once else F.collect_list
    own = tips.select(tree, "label").repartition(n, tree).groupBy(tree).agg(collect(F.struct("label")).alias("_l"))  # a null is kept in a struct
    every = taxa.agg(F.sort_array(F.collect_set("label"))).scalar()
    own = own.select(tree, F.array_sort(F.transform("_l", lambda x: x["label"])).alias("_have")).withColumn("_all", every)
    again = F.filter("_have", lambda x, i: (i > 0) & x.eqNullSafe(F.get("_have", i - 1)))
    named = lambda kind, found: F.transform(found, lambda x: F.struct(x.alias("label"), F.lit(kind).alias("problem")))
    problems = [named(kind, found) for kind, found in (
        ("duplicate", F.array_distinct(again)), ("unknown", F.array_except("_have", "_all")), ("missing", F.array_except("_all", "_have")))]
    return own.select(tree, F.explode(F.concat(*problems)).alias("p")).select(tree, "p.label", "p.problem")


def negative_lengths(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("length") < 0)


def unknown_outgroup(outgroup: DataFrame, taxa: DataFrame) -> DataFrame:
    return outgroup.select("label").join(taxa.select("label"), "label", "left_anti")


def unknown_constraint_taxa(constraint_tips: DataFrame, taxa: DataFrame) -> DataFrame:
    return constraint_tips.select("label").distinct().join(taxa.select("label"), "label", "left_anti")


def constraint_tip_order(taxa: DataFrame, constraint_tips: DataFrame) -> DataFrame:
    """Constrained taxa first, then the free ones, each in alignment order.

    Two dense numberings, the free one shifted by the size of the first group, so that no
    task has to sort the whole taxon list.
    """
    from cladeframe.operators.sites import dense_offsets

    tips = constraint_tips.select("label").distinct().withColumn("_c", F.lit(1))
    marked = taxa.join(tips, "label", "left").withColumn("constrained", F.col("_c").isNotNull()).drop("_c")
    ranked = dense_offsets(marked, "taxon_id", by=("constrained",), name="_r")
    shift = marked.where("constrained").agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn("_n", shift).select(
        "taxon_id", "label", "constrained",
        (F.col("_r") + F.when(F.col("constrained"), 0).otherwise(F.col("_n"))).alias("tip_index"))


def zero_freqs(freqs: DataFrame, minimum: float = 1e-3) -> DataFrame:
    return freqs.where(F.col("freq") < minimum)


def user_freqs_off(freqs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Partitions whose user frequencies do not sum to one within the tolerance."""
    return freqs.groupBy("part_id").agg(F.sum("freq").alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def ascbias_invariant(stats: DataFrame) -> DataFrame:
    """Partitions where an ascertainment correction is impossible: they have invariant columns."""
    return stats.where("inv_prop > 0").select("part_id", "inv_count")


def overfit(parts: DataFrame, unlinked: bool = False) -> DataFrame:
    """(part_id, free_params, site_count) -> verdict where parameters reach the column count."""
    return parts.where(F.col("free_params") >= F.col("site_count")).withColumn(
        "verdict", F.when(F.col("model_params") >= F.col("site_count"), "error").otherwise(
            F.lit("error" if unlinked else "warning")))
