import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import states
from cladeframe.operators import balance as B
from cladeframe.operators import bootstrap as BS
from cladeframe.operators import checks as C
from cladeframe.operators import sites as S
from cladeframe.operators.partitions import AlignmentView, cover_counts, parse_ranges, split_by_ranges

RNG = np.random.default_rng(11)
TAXA = ["t1", "t2", "t3", "t4", "t5"]
COLS = ["".join(RNG.choice(list("ACGT"), 5)) for _ in range(60)]
SCHEMES = {"one": [(0, 1, 60, 1)], "three": [(0, 1, 10, 1), (1, 11, 45, 1), (2, 46, 60, 1)]}


def columns(spark, scheme="one", cols=COLS):
    df = spark.createDataFrame([(0, i + 1, c) for i, c in enumerate(cols)], "part_id INT, site BIGINT, pattern STRING")
    return split_by_ranges(df, SCHEMES[scheme])


def sequence(view, taxon, uncompress=True):
    rows = view.sequence_chunks(7, uncompress).where(F.col("taxon") == taxon).orderBy("part_id", "chunk").collect()
    return "".join(r["segment"] for r in rows)


@pytest.mark.parametrize("scheme", ["one", "three"])
def test_views(spark, scheme):
    s = columns(spark, scheme)
    v = AlignmentView(s, TAXA)
    assert v.identity and sequence(v, 2) == "".join(c[2] for c in COLS)
    weights = s.select("part_id", "site", (F.col("site") % 5).alias("weight"))
    w = v.weights(weights)
    assert not w.identity
    assert {r[0]: r[1] for r in w.total_sites().collect()} == {
        r[0]: r[1] for r in weights.groupBy("part_id").agg(F.sum("weight")).collect()}
    assert sequence(w, 1) == "".join(c[1] * ((i + 1) % 5) for i, c in enumerate(COLS))
    out = spark.createDataFrame([(0, 1), (0, 3), (0, 6)], "part_id INT, site BIGINT")
    x = w.exclude_sites(out).exclude_taxa([3]).rename({"t2": "Mouse"})
    assert x.labels == ["t1", "Mouse", "t3", "t5"]
    assert x.total_sites().agg(F.sum("sites")).first()[0] == sum((i + 1) % 5 for i in range(60)) - (1 + 3 + 1)
    assert sequence(x, 3) == "".join(c[4] * ((i + 1) % 5) for i, c in enumerate(COLS) if i + 1 not in (1, 3, 6))


def test_compression_folds_synonyms(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate(["ACG-", "acg?", "UCGN", "TCG-", "ACGN"])], "part_id INT, site BIGINT, pattern STRING")
    got = {r["pattern"]: (r["weight"], r["first_site"]) for r in S.compress_patterns(df, states.dna()).collect()}
    assert sorted(got.values()) == [(2, 2), (3, 0)]
    assert S.compress_patterns(df).count() == 5


def test_sites_from_many_taxa(spark):
    taxa = list(range(100))
    cells = spark.createDataFrame([(0, s, t, "ACGT"[(s + t) % 4]) for s in range(3) for t in taxa if t != 50], "part_id INT, site BIGINT, taxon_id BIGINT, state STRING")
    got = {r["site"]: r["pattern"] for r in S.sites_from_cells(cells, taxa).collect()}
    assert got[1] == "".join("-" if t == 50 else "ACGT"[(1 + t) % 4] for t in taxa)


@pytest.mark.parametrize("kind", ["dna", "protein", "binary", "genotype"])
def test_statistics_against_a_loop(spark, kind):
    a = getattr(states, kind)()
    rng = np.random.default_rng(5)
    syms = [c for c in a.masks if c.isprintable()]
    cols = ["".join(rng.choice(syms, 6)) for _ in range(40)]
    df = spark.createDataFrame([(0, c, 1 + i % 3, i) for i, c in enumerate(cols)], "part_id INT, pattern STRING, weight BIGINT, first_site BIGINT")
    r = S.part_stats(df, a).first()
    w = [1 + i % 3 for i in range(40)]
    freq = np.zeros(a.size)
    gap = inv = 0
    for c, k in zip(cols, w):
        common = a.full
        for ch in c:
            m = a.masks[ch]
            common &= m
            gap += k * (m == a.full)
            for j in range(a.size):
                if m >> j & 1:
                    freq[j] += k / bin(m).count("1")
        inv += k * (common != 0)
    assert r["site_count"] == sum(w) and np.isclose(r["gap_prop"], gap / (6 * sum(w))) and np.isclose(r["inv_prop"], inv / sum(w))
    assert r["inv_count"] == inv and np.allclose(r["base_freqs"], freq / freq.sum())


def test_dense_offsets_cross_buckets(spark):
    ids = sorted(np.random.default_rng(2).choice(10**6, 500, replace=False).tolist())
    df = spark.createDataFrame([(int(i), k % 2, int(i) % 7) for k, i in enumerate(ids)], "id BIGINT, g INT, v INT")
    got = {r["id"]: r["o"] for r in S.dense_offsets(df, "id", F.col("v"), by=("g",), bucket=50000, name="o").collect()}
    for g in (0, 1):
        run = 0
        for k, i in enumerate(ids):
            if k % 2 == g:
                assert got[i] == run
                run += i % 7


def test_ranges(spark):
    df = spark.createDataFrame([(0, "1-10\\3, 12"), (1, "2-9/3,20 - 22")], "part_id INT, range_string STRING")
    got = sorted(tuple(r) for r in parse_ranges(df).collect())
    assert got == [(0, 1, 10, 3), (0, 12, 12, 1), (1, 2, 9, 3), (1, 20, 22, 1)]
    bad = cover_counts(parse_ranges(df), spark.range(1, 13).withColumnRenamed("id", "site"))
    assert {r["site"]: r["n"] for r in bad.collect()} == {3: 0, 6: 0, 9: 0, 11: 0}
    for text in ("0-3", "5-2", "abc", "1-20", "1-x"):
        with pytest.raises(Exception, match="invalid range"):
            parse_ranges(spark.createDataFrame([(0, text)], "part_id INT, range_string STRING"), F.lit(15)).collect()


def test_exact_duplicates_and_gap_taxa(spark):
    cols = ["AAC-", "CCG?", "TTTN"]
    df = spark.createDataFrame([(0, c, 1) for c in cols], "part_id INT, pattern STRING, weight BIGINT")
    assert C.identical_taxa(df, 4) == [(0, 1)]
    assert C.undetermined_taxa(df, {0: states.dna()}) == [3]


def test_resampling(spark):
    s = columns(spark, "three", COLS)
    p = S.compress_patterns(s)
    n = {r["part_id"]: r["n"] for r in p.groupBy("part_id").agg(F.sum("weight").alias("n")).collect()}
    for w in (BS.draw_weights(s, 20), BS.multinomial_weights(p, 20, 3)):
        for r in w.groupBy("replicate", "part_id").agg(F.sum("weight").alias("n")).collect():
            assert r["n"] == n[r["part_id"]]
        assert w.join(p, ["part_id", "pattern"], "left_anti").count() == 0
    a = sorted(map(tuple, BS.multinomial_weights(p, 5, 3).collect()))
    assert a == sorted(map(tuple, BS.multinomial_weights(p.repartition(7), 5, 3).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert a == sorted(map(tuple, BS.multinomial_weights(p.coalesce(1), 5, 3).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_draws_over_several_units(spark, monkeypatch):
    """Group, unit and pattern levels together draw as many columns as there are."""
    monkeypatch.setattr(BS, "UNIT", 4)
    monkeypatch.setattr(BS, "GROUP", 3)
    p = spark.range(50).selectExpr("0 AS part_id", "concat('A', id) AS pattern", "1 + id % 7 AS weight", "id * 3 AS first_site")
    got = BS.multinomial_weights(p, 400, 5)
    assert {r["n"] for r in got.groupBy("replicate").agg(F.sum("weight").alias("n")).collect()} == {p.agg(F.sum("weight")).first()[0]}
    mean = {r["pattern"]: r["m"] for r in got.groupBy("pattern").agg((F.sum("weight") / 400).alias("m")).collect()}
    for r in p.collect():
        assert abs(mean[r["pattern"]] - r["weight"]) < 5 * np.sqrt(r["weight"] / 400)


def test_replicate_chunks_are_cut_by_output(spark):
    """A pattern that holds most columns covers many chunks, none of them longer than asked for."""
    p = spark.createDataFrame([(0, "AC", 3, 5), (0, "GT", 9, 7), (1, "TT", 1, 0)], "part_id INT, pattern STRING, weight BIGINT, first_site BIGINT")
    w = spark.createDataFrame([(0, 0, "AC", 2), (0, 0, "GT", 25), (1, 0, "AC", 27), (0, 1, "TT", 1)], "replicate INT, part_id INT, pattern STRING, weight BIGINT")
    rows = BS.replicate_chunks(w, p, 2, 10).collect()
    text = {}
    for r in sorted(rows):
        assert len(r["segment"]) <= 10
        text[r["replicate"], r["part_id"], r["taxon"]] = text.get((r["replicate"], r["part_id"], r["taxon"]), "") + r["segment"]
    assert text == {(0, 0, 0): "AA" + "G" * 25, (0, 0, 1): "CC" + "T" * 25, (1, 0, 0): "A" * 27, (1, 0, 1): "C" * 27, (0, 1, 0): "T", (0, 1, 1): "T"}


def test_multinomial_has_the_right_distribution(spark):
    p = spark.createDataFrame([(0, x, w, i) for i, (x, w) in enumerate([("A", 70), ("C", 20), ("G", 9), ("T", 1)])],
                              "part_id INT, pattern STRING, weight BIGINT, first_site BIGINT")
    got = BS.multinomial_weights(p, 2000, 1).groupBy("pattern").agg((F.sum("weight") / 2000).alias("m"), F.stddev_pop("weight").alias("s")).collect()
    mean = {r["pattern"]: r["m"] for r in got}
    for x, w in (("A", 70), ("C", 20), ("G", 9), ("T", 1)):
        assert abs(mean[x] - w) < 4 * np.sqrt(w * (1 - w / 100) / 2000)
    sd = {r["pattern"]: r["s"] for r in got}
    assert abs(sd["A"] - np.sqrt(70 * 0.3)) < 0.3


@pytest.mark.parametrize("procs", [2, 9, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_balance(spark, procs, seed):
    rng = np.random.default_rng(seed)
    sizes = [(i, 0, int(rng.integers(1, 5000)), float(rng.integers(2, 80))) for i in range(40)]
    parts = spark.createDataFrame(sizes, "part_id INT, start BIGINT, length BIGINT, per_site_weight DOUBLE")
    total = sum(x[2] for x in sizes)
    weight = sum(x[2] * x[3] for x in sizes)
    for fn in (B.equal_chunks, B.even_ranges, B.weighted_ranges):
        a = fn(parts, procs).toPandas()
        for i, _, n, _ in sizes:
            g = a[(a.part_id == i) & (a.length > 0)].sort_values("start")
            assert g.length.sum() == n and (g.start.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all()
    per = B.even_ranges(parts, procs).groupBy("proc").agg(F.sum("length").alias("n")).toPandas().n
    assert len(per) == procs and per.min() >= total // procs and per.max() <= -(-total // procs)
    w = B.weighted_ranges(parts, procs).groupBy("proc").agg(F.sum(F.col("length") * F.col("per_site_weight")).alias("w")).toPandas().w
    assert len(w) == procs and w.max() <= weight / procs + 80


def test_thousands_of_partitions(spark):
    """4,116 partitions with strides and gaps between their parts: as a loop over all ranges says, in one stage without a shuffle."""
    rng = np.random.default_rng(5)
    ranges, at = [], 1
    for p in range(4116):
        n = int(rng.integers(1, 12))
        k = int(rng.integers(1, 4))
        if k == 1 or p + k > 4116:
            ranges.append((p, at, at + n - 1, 1))
        else:  # interleaved with itself: every stride of a block belongs to this partition or the one a third on
            ranges += [((p + 1372 * j) % 4116, at + j, at + n - 1, k) for j in range(min(k, n))]
        at += n
    owner = {}
    for p, a, b, k in ranges:
        for x in range(a, b + 1, k):
            assert x not in owner
            owner[x] = p
    got = split_by_ranges(spark.range(1, at).withColumnRenamed("id", "site"), ranges)
    assert {(r.site, r.part_id) for r in got.collect()} == set(owner.items()) and len(owner) == at - 1
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    for odd in (0, at, 5 * at):
        with pytest.raises(Exception, match="not covered exactly once"):
            split_by_ranges(spark.createDataFrame([(odd,)], "site BIGINT"), ranges).collect()
    with pytest.raises(Exception, match="not covered exactly once"):
        split_by_ranges(spark.createDataFrame([(3,)], "site BIGINT"), [(0, 1, 5, 1), (1, 3, 3, 1)]).collect()
