"""Building, compressing and describing alignments held one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions.states import Alphabet, canonical_symbols, dna, state_mask

PIVOT_LIMIT = 64


def sites_from_cells(cells: DataFrame, taxa: Sequence, key: Sequence[str] = ("part_id", "site"),
                     taxon: str = "taxon_id", state: str = "state", gap: str = "-") -> DataFrame:
    """Long cells -> one row per column, taxa in the given order, gaps where no cell exists.

    Up to ``PIVOT_LIMIT`` taxa the row is one aggregate per taxon: fixed-size buffers that
    combine map-side, so repeated cells of a hot column never travel.  Beyond that the
    cells are first made unique per (column, taxon), which bounds every group by the
    number of taxa.
    """
    if len(taxa) <= PIVOT_LIMIT:
        aggs = [F.max(F.when(F.col(taxon) == F.lit(t), F.col(state))).alias(f"s{i}") for i, t in enumerate(taxa)]
        wide = cells.groupBy(*key).agg(*aggs)
        return wide.select(*key, F.concat(*[F.coalesce(f"s{i}", F.lit(gap)) for i in range(len(taxa))]).alias("pattern"))
    order = F.array(*[F.lit(t) for t in taxa])
    unique = cells.groupBy(*key, taxon).agg(F.max(state).alias("_s"))
    rows = unique.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(taxon, "_s"))).alias("_m"))
    sym = F.transform(order, lambda t: F.coalesce(F.element_at("_m", t), F.lit(gap)))
    return rows.select(*key, F.array_join(sym, "").alias("pattern"))


def cells_from_sites(sites: DataFrame, columns: Sequence[str] = ("part_id", "site")) -> DataFrame:
    """One row per column -> long cells; ``taxon_id`` is the 0-based position in the pattern."""
    return sites.select(*columns, F.posexplode(F.split("pattern", "")).alias("taxon_id", "state")).withColumn(
        "taxon_id", F.col("taxon_id").cast("bigint"))


def compress_patterns(sites: DataFrame, alphabet: Alphabet | None = None, weight: str | None = None) -> DataFrame:
    """Identical columns of a partition -> one pattern with its weight and first column.

    Synonymous symbols are folded by a JVM translate first; the sum is combined map-side, so
    a pattern that covers a third of all columns costs one row per task.
    """
    p = canonical_symbols(F.col("pattern"), alphabet) if alphabet else F.col("pattern")
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    return sites.select("part_id", p.alias("pattern"), w.alias("_w"), "site").groupBy("part_id", "pattern").agg(
        F.sum("_w").alias("weight"), F.min("site").alias("first_site"))


def merge_by_datatype(patterns: DataFrame, datatypes: dict[int, str]) -> DataFrame:
    """Partitions of equal data type concatenated and compressed again (parsimony input)."""
    pairs = [F.lit(x) for k, v in sorted(datatypes.items()) for x in (k, v)]
    kind = F.element_at(F.create_map(*pairs), F.col("part_id"))
    return patterns.groupBy(kind.alias("datatype"), "pattern").agg(
        F.sum("weight").alias("weight"), F.min("first_site").alias("first_site"))


def state_count(pattern: Column, symbols: str) -> Column:
    """How many of ``symbols`` occur in the column, without exploding it."""
    return F.length(pattern) - F.length(F.translate(pattern, symbols, ""))


def _symbols_by_mask(alphabet: Alphabet) -> dict[int, str]:
    out: dict[int, str] = {}
    for c, m in sorted(alphabet.masks.items()):
        out[m] = out.get(m, "") + c
    return out


def invariant(pattern: Column, alphabet: Alphabet) -> Column:
    """True if one state is compatible with every symbol of the column."""
    test = F.lit(False)
    for i in range(alphabet.size):
        ok = "".join(c for c, m in sorted(alphabet.masks.items()) if m >> i & 1)
        test = test | (F.translate(pattern, ok, "") == "")
    return test


def undetermined(pattern: Column, alphabet: Alphabet) -> Column:
    gaps = "".join(c for c, m in sorted(alphabet.masks.items()) if m == alphabet.full)
    return F.translate(pattern, gaps, "") == ""


def state_shares(pattern: Column, alphabet: Alphabet) -> list[Column]:
    """Per state: its count in the column, ambiguous symbols split evenly over their states."""
    groups = _symbols_by_mask(alphabet)
    counts = {m: state_count(pattern, s) for m, s in groups.items()}
    shares = []
    for i in range(alphabet.size):
        terms = [counts[m] / float(bin(m).count("1")) for m in counts if m >> i & 1]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        shares.append(total)
    return shares


def part_stats(patterns: DataFrame, alphabet: Alphabet | None = None) -> DataFrame:
    """Columns, patterns, gap and invariant share and state frequencies per partition.

    One aggregation over the compressed columns; every per-column quantity is a scalar
    expression on the pattern string.
    """
    a = alphabet or dna()
    gaps = "".join(c for c, m in sorted(a.masks.items()) if m == a.full)
    p, w = F.col("pattern"), F.col("weight")
    shares = state_shares(p, a)
    agg = patterns.groupBy("part_id").agg(
        F.sum(w).alias("site_count"),
        F.count(F.lit(1)).alias("pattern_count"),
        F.sum(w * state_count(p, gaps)).alias("_gap"),
        F.sum(w * F.length(p)).alias("_cells"),
        F.sum(F.when(invariant(p, a), w).otherwise(0)).alias("_inv"),
        *[F.sum(w * s).alias(f"_f{i}") for i, s in enumerate(shares)],
    )
    total = F.expr(" + ".join(f"_f{i}" for i in range(a.size)))
    return agg.select(
        "part_id", "site_count", "pattern_count",
        (F.col("_gap") / F.col("_cells")).alias("gap_prop"),
        (F.col("_inv") / F.col("site_count")).alias("inv_prop"),
        F.array(*[F.col(f"_f{i}") / total for i in range(a.size)]).alias("base_freqs"),
    ).withColumn("inv_count", F.floor(F.col("site_count") * F.col("inv_prop") + F.lit(1e-9)).cast("bigint"))


def empirical_freqs(patterns: DataFrame, alphabet: Alphabet | None = None) -> DataFrame:
    a = alphabet or dna()
    stats = part_stats(patterns, a)
    return stats.select("part_id", F.posexplode("base_freqs").alias("_i", "freq")).select(
        "part_id", F.substring(F.lit(a.states), F.col("_i") + 1, F.lit(1)).alias("state"), "freq")


def empirical_rates(patterns: DataFrame, alphabet: Alphabet | None = None) -> DataFrame:
    """State co-occurrence per column, relative to the last pair of states."""
    a = alphabet or dna()
    p, w = F.col("pattern"), F.col("weight")
    groups = _symbols_by_mask(a)
    n = [state_count(p, groups[1 << i]) for i in range(a.size)]
    pairs = [(i, j) for i in range(a.size) for j in range(i + 1, a.size)]
    agg = patterns.groupBy("part_id").agg(*[F.sum(w * n[i] * n[j]).alias(f"_{i}_{j}") for i, j in pairs])
    last = F.col("_%d_%d" % pairs[-1])
    entries = F.array(*[F.struct(F.lit(a.states[i] + a.states[j]).alias("pair"), F.col(f"_{i}_{j}").alias("n"),
                                 (F.col(f"_{i}_{j}") / last).alias("rate")) for i, j in pairs])
    return agg.select("part_id", F.explode(entries).alias("e")).select("part_id", "e.pair", "e.n", "e.rate")


def totals(patterns: DataFrame) -> DataFrame:
    """Length per partition and in total (``part_id`` null), as one rollup."""
    return patterns.rollup("part_id").agg(F.sum("weight").alias("sites"), F.count(F.lit(1)).alias("patterns"))


def gap_columns(sites: DataFrame, alphabet: Alphabet | None = None) -> DataFrame:
    return sites.where(undetermined(F.col("pattern"), alphabet or dna()))


def drop_gap_columns(sites: DataFrame, alphabet: Alphabet | None = None) -> DataFrame:
    """A narrow filter: no join against a list of columns is needed."""
    return sites.where(~undetermined(F.col("pattern"), alphabet or dna()))


def probability_freqs(prob_cells: DataFrame) -> DataFrame:
    """Mean of per-cell state probability vectors (``probs`` ARRAY<DOUBLE>)."""
    long = prob_cells.select(F.posexplode("probs").alias("state_no", "p"))
    return long.groupBy("state_no").agg(F.avg("p").alias("freq"))


def probabilities_normalised(prob_cells: DataFrame) -> DataFrame:
    """Whether every probability is at most one (otherwise the vectors need scaling)."""
    return prob_cells.select(F.array_max("probs").alias("m")).agg((F.max("m") <= 1.0).alias("normalised"))


def tip_vector(probs: Column) -> Column:
    """Tip likelihood vector: scale when a probability exceeds one, all ones when all are zero."""
    total = F.aggregate(probs, F.lit(0.0), lambda acc, x: acc + x)
    scaled = F.when(F.array_max(probs) > 1.0, F.transform(probs, lambda x: x / total)).otherwise(probs)
    return F.when(F.array_max(probs) <= 0.0, F.transform(probs, lambda x: F.lit(1.0))).otherwise(scaled)


def dense_offsets(df: DataFrame, order: str, value: Column | None = None, by: Sequence[str] = (),
                  bucket: int = 65536, name: str = "offset") -> DataFrame:
    """Exclusive running sum of ``value`` (1 by default) in ``order``, without a global sort.

    Rows fall into buckets of the order column; bucket totals get a running sum on a table
    that is ``bucket`` times smaller, and a second running sum stays inside each bucket.
    ``order`` must be unique within ``by``, which bounds every bucket.
    """
    v = (value if value is not None else F.lit(1)).cast("bigint")
    keyed = df.withColumn("_bucket", F.floor(F.col(order) / bucket)).withColumn("_value", v)
    sums = keyed.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum_in_bucket"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum_in_bucket").over(before), F.lit(0)).alias("_before_bucket"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(base, [*by, "_bucket"])
    return out.withColumn(name, F.col("_before_bucket") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_bucket", "_value", "_before_bucket")


def mask_cells(cells: DataFrame, alphabet: Alphabet, state: str = "state") -> DataFrame:
    return cells.withColumn("mask", state_mask(F.col(state), alphabet))
