import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import newick as nw
from cladeframe.operators import halves as H
from cladeframe.operators import trees as T
from cladeframe.operators import treesets as TS
from cladeframe.streaming.convergence import watch
from cladeframe.sources.sinks import write_rf

LABELS = [f"x{i}" for i in range(9)]
INDEX = {x: i for i, x in enumerate(LABELS)}


def randoms(spark, n, seed=1):
    ids = spark.range(n).withColumnRenamed("id", "tree_id")
    return T.random_trees(ids, LABELS, seed)


def split_sets(trees):
    return {r["tree_id"]: {s for s, _ in nw.splits(nw.parse(r["newick"]), INDEX)} for r in trees.collect()}


def similar(spark, n=40):
    """Trees that share most splits: one backbone with a few random regrafts of tips."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        order = list(range(9))
        if rng.random() < 0.7:
            a = int(rng.integers(8))
            order[a], order[a + 1] = order[a + 1], order[a]
        t = f"({LABELS[order[0]]},{LABELS[order[1]]})"
        for k in order[2:-1]:
            t = f"({t},{LABELS[k]})"
        rows.append((i, f"({t},{LABELS[order[-1]]});"))
    return spark.createDataFrame(rows, "tree_id BIGINT, newick STRING")


def test_newick_round_trip_and_errors():
    t = nw.parse("((a:0.1,'b c':0.2)95:0.3,(d,e:1e-3):0.5);")
    assert nw.write(t) == "(a:0.100000,b c:0.200000,(d,e:0.001000):0.800000)95;" or "0.800000" in nw.write(t)
    assert len(nw.parse("(a,b);").parent) == 3
    for bad in ("(a,b", "a,b;", "((a,b);", "(a,b));"):
        with pytest.raises(ValueError):
            nw.parse(bad)
    deep = "(" * 3000 + "x0" + "".join(f",y{i})" for i in range(3000)) + ";"
    assert len(nw.parse(deep).tips()) == 3001 and nw.write(nw.parse(deep)).endswith(";")


def test_random_trees_are_binary_and_reproducible(spark):
    a, b = randoms(spark, 30), randoms(spark, 30)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.repartition(7).collect()))
    assert T.tree_shape(a).where("is_binary AND tips = 9").count() == 30
    assert all(len(s) == 6 for s in split_sets(a).values())


def test_rf_is_a_metric_and_blocks_agree(spark):
    t = randoms(spark, 25).unionByName(similar(spark, 15).withColumn("tree_id", F.col("tree_id") + 100))
    sets = split_sets(t)
    s = T.tree_splits(t, LABELS).select("tree_id", "split")
    for block in (4, 512):
        got = {(r["tree_i"], r["tree_j"]): r["rf"] for r in TS.rf_pairwise(s, t, 9, block).collect()}
        assert got == {(i, j): len(sets[i] ^ sets[j]) for i, j in itertools.combinations(sorted(sets), 2)}
    avg = TS.rf_average(t, LABELS).first()
    assert np.isclose(avg["avg_rf"], np.mean(list(got.values()))) and np.isclose(avg["avg_rrf"], avg["avg_rf"] / 12)
    assert avg["unique_trees"] == len({frozenset(x) for x in sets.values()})


def test_star_trees_have_no_splits(spark):
    star = "(" + ",".join(LABELS) + ");"
    t = spark.createDataFrame([(0, star), (1, star), (2, randoms(spark, 1).first()["newick"])], "tree_id BIGINT, newick STRING")
    s = T.tree_splits(t, LABELS).select("tree_id", "split")
    assert {(r["tree_i"], r["tree_j"]): r["rf"] for r in TS.rf_pairwise(s, t, 9).collect()} == {(0, 1): 0, (0, 2): 6, (1, 2): 6}
    assert TS.rf_average(t, LABELS).first()["unique_trees"] == 2


def test_support_of_identical_trees(spark):
    t = similar(spark, 1)
    many = t.crossJoin(spark.range(5).toDF("k")).select(F.col("k").alias("tree_id"), "newick")
    s = T.tree_splits(many, LABELS).select("tree_id", "split")
    ref = T.tree_splits(t, LABELS)
    assert {r["percent"] for r in TS.support_fbp(ref, s, trees=many).collect()} == {100}
    assert {round(r["support"], 9) for r in TS.support_tbe([r["split"] for r in ref.collect()], s, many).collect()} == {1.0}
    # a replicate without splits supports nothing and counts
    star = many.unionByName(spark.createDataFrame([(9, "(" + ",".join(LABELS) + ");")], many.schema))
    s = T.tree_splits(star, LABELS).select("tree_id", "split")
    got = TS.support_tbe([r["split"] for r in ref.collect()], s, star).collect()
    assert {round(r["support"], 9) for r in got} == {round(5 / 6, 9)}


def test_rf_file_numbers_trees_from_zero(spark, tmp_path):
    trees = spark.createDataFrame([(7, "x"), (30, "y"), (12, "z")], "tree_id BIGINT, newick STRING")
    pairs = spark.createDataFrame([(12, 30, 4, 0.5), (7, 30, 2, 0.25), (7, 12, 0, 0.0)], "tree_i BIGINT, tree_j BIGINT, rf INT, rrf DOUBLE")
    write_rf(pairs, trees, str(tmp_path / "rf"), precision=2)
    lines = [x for f in sorted((tmp_path / "rf").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["0\t1\t0\t0.00", "0\t2\t2\t0.25", "1\t2\t4\t0.50"]


def test_tbe_against_a_loop(spark):
    t = randoms(spark, 12, 4)
    ref = similar(spark, 1)
    sets = split_sets(t)
    got = {r["split"]: r["support"] for r in TS.support_tbe([r["split"] for r in T.tree_splits(ref, LABELS).collect()],
                                                             T.tree_splits(t, LABELS), t).collect()}
    for s, _ in nw.splits(nw.parse(ref.first()["newick"]), INDEX):
        b = nw.bits(s)
        p = min(b.sum(), 9 - b.sum())
        best = []
        for held in sets.values():
            cand = [nw.bits(x) for x in held] + [np.eye(9, dtype=np.uint8)[i] for i in range(9)]
            best.append(min(min(int((b != c).sum()), 9 - int((b != c).sum())) for c in cand))
        assert np.isclose(got[s], 1 - np.mean(best) / (p - 1))


def _greedy(counts, n, limit):
    out = []
    for s, k in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        b = {i for i, c in enumerate(s) if c == "1"}
        ok = all(not (b & o) or b <= o or o <= b for o in out)
        if (k > limit or ok) and len(out) < n - 3:
            out.append(b)
    return {"".join("1" if i in b else "0" for i in range(n)) for b in out}


def test_consensus_hierarchy(spark, monkeypatch):
    t = similar(spark).unionByName(randoms(spark, 10).withColumn("tree_id", F.col("tree_id") + 100))
    s = T.tree_splits(t, LABELS).select("tree_id", "split").persist()
    sets = split_sets(t)
    counts: dict = {}
    for x in sets.values():
        for k in x:
            counts[k] = counts.get(k, 0) + 1
    got = {k: {r["split"] for r in TS.consensus_splits(s, 50, 9, k).collect()} for k in ("STRICT", "MR", "MR70", "MRE")}
    assert got["STRICT"] <= got["MR70"] <= got["MR"] <= got["MRE"]
    assert got["MRE"] == _greedy(counts, 9, 25)
    monkeypatch.setattr(TS, "GREEDY_BATCH", 2)
    assert {r["split"] for r in TS.consensus_splits(s, 50, 9, "MRE").collect()} == got["MRE"]
    c = TS.consensus_splits(s, 50, 9, "MRE")
    text = TS.consensus_tree(c, LABELS).first()["newick"]
    assert {x for x, _ in nw.splits(nw.parse(text), INDEX)} == got["MRE"]
    for bad in ("MR40", "XX"):
        with pytest.raises(ValueError):
            TS.consensus_splits(s, 50, 9, bad)


def test_bootstop_against_a_loop(spark):
    t = similar(spark, 40)
    s = T.tree_splits(t, LABELS).select(F.col("tree_id").alias("tree_no"), "split")
    ids = t.select(F.col("tree_id").alias("tree_no"))
    got = {r["trees"]: r for r in H.bootstop(s, ids, 9, [20, 40], 6).collect()}
    sets = split_sets(t)
    side = {(r["perm"], r["tree_no"]): r["half"] for r in H.halves(ids, 6).collect()}
    for p in range(6):
        assert all(side[p, 2 * k] + side[p, 2 * k + 1] == 1 for k in range(20))
        assert [side[p, i] for i in range(40)] == [int(H.half_of(i, np.array([p]), 1)[0]) for i in range(40)]
    assert len({tuple(side[p, i] for i in range(40)) for p in range(6)}) == 6
    for b in (20, 40):
        wrf, limit, better = [], [], 0
        for p in range(6):
            sup = ({}, {})
            for i in range(b):
                for x in sets[i]:
                    for h in (0, 1):
                        sup[h].setdefault(x, 0)
                    sup[side[p, i]][x] += 1
            cons = [_greedy(sup[h], 9, b // 4) for h in (0, 1)]
            d = sum(abs((sup[0][x] if x in cons[0] else 0) - (sup[1][x] if x in cons[1] else 0)) for x in cons[0] | cons[1])
            m = 0.03 * 0.5 * b * (len(cons[0]) + len(cons[1]))
            wrf.append(d)
            limit.append(m)
            better += d <= m
        assert np.isclose(got[b]["avg_wrf"], np.mean(wrf)) and got[b]["better"] == better
        assert got[b]["converged"] == (better >= 5 and np.mean(wrf) <= np.mean(limit))
    assert H.report_prefixes(120) == [50, 100, 120] and H.report_prefixes(100) == [50, 100] and H.report_prefixes(7) == [7]
    with pytest.raises(NotImplementedError):
        TS.check_metric("autoFC")


def test_reroot_and_lengths(spark):
    t = similar(spark, 1)
    r = T.reroot(t, ["x0", "x1"]).first()
    assert r["newick"].count("(") == 8
    full = T.fill_lengths(t)
    assert full.first()["newick"].count(":0.100000") == 15
    mono = {tuple(o): T.reroot(t, o).first()["monophyletic"] for o in (["x8"], ["x0", "x8"])}
    assert mono[("x8",)] and not mono[("x0", "x8")]


def test_stream_reports_like_the_batch(spark, tmp_path):
    t = similar(spark, 40)
    src = tmp_path / "in"
    rows = t.select(F.col("tree_id").alias("tree_no"), "newick")
    for k in range(4):
        rows.where(f"tree_no >= {10 * k} AND tree_no < {10 * k + 10}").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    seen = []
    watched = watch(stream, LABELS, str(tmp_path / "out"), 20, 6, on_report=lambda df: seen.extend(df.collect()))
    watched.wait()
    s = T.tree_splits(t, LABELS).select(F.col("tree_id").alias("tree_no"), "split")
    ids = t.select(F.col("tree_id").alias("tree_no"))
    want = {tuple(r) for r in H.report(s, ids, 9, [20, 40], 6).collect()}
    assert {tuple(r) for r in seen} == want == {tuple(r) for r in watched.report().collect()}


def test_counts_in_any_order_and_block(spark, monkeypatch):
    """Counts over several blocks of permutations, saved and loaded between trees, equal those of one pass; splits beyond the kept pairs too."""
    t = similar(spark, 30)
    sets = split_sets(t)
    one = H.HalfCounts(range(7), 9, 1)
    parts = [H.HalfCounts(range(4), 9, 1), H.HalfCounts(range(4, 7), 9, 1)]
    for i in range(30):
        one.add(i, sorted(sets[i]))
        for c in parts:
            c.add(i, sorted(sets[i], reverse=True))
        parts = [H.HalfCounts.load(c.dump()) for c in parts]
    want = sorted(one.distances(30))
    assert sorted(r for c in parts for r in c.distances(30)) == want
    monkeypatch.setattr(H, "PAIRS_KEPT", 0)
    assert sorted(one.distances(30)) == want
    assert list(H.HalfCounts(range(3), 9, 1).distances(0)) == []


def test_report_stops_at_the_first_that_converges(spark):
    """Equal trees converge at once, so later prefixes aren't told; the stream then leaves its rest unread."""
    text = "(x0,x1,((x2,x3),((x4,x5),((x6,x7),x8))));"
    t = spark.range(60).select(F.col("id").alias("tree_no"), F.lit(text).alias("newick"))
    s = T.tree_splits(t.withColumnRenamed("tree_no", "tree_id"), LABELS).select(F.col("tree_id").alias("tree_no"), "split")
    got = [tuple(r) for r in H.report(s, t, 9, [10, 20, 30, 40, 50, 60], 30).collect()]
    assert got == [(10, 0.0, 0.0, 30, True)]
    none = H.report(s.where("false"), t, 9, [10], 30).collect()
    assert [tuple(r)[:2] + tuple(r)[3:] for r in none] == [] or none[0]["trees"] == 10


def test_newick_quotes_labels():
    from cladeframe.functions import newick

    text = "(a,'b c',(d,'e''s(1)'));"
    again = newick.parse(newick.write(newick.parse(text), lengths=False))
    assert sorted(again.label[v] for v in again.tips()) == sorted(newick.parse(text).label[v] for v in newick.parse(text).tips())
    assert len(again.tips()) == 4


def test_missing_tips_of_a_tree_without_known_ones(spark):
    from cladeframe.operators.checks import tree_taxa_mismatch

    tips = spark.createDataFrame([("t", "x"), ("t", "y")], "tree_id string, label string")
    taxa = spark.createDataFrame([("a",), ("b",)], "label string")
    got = {(r.label, r.problem) for r in tree_taxa_mismatch(tips, taxa).collect()}
    assert got == {("x", "unknown"), ("y", "unknown"), ("a", "missing"), ("b", "missing")}


@pytest.mark.parametrize("name", ["halves", "half_support", "mre", "wrf", "converged", "report"])
def test_reduced_convergence_shuffles_every_prefix(spark, name):
    """Beside the SQL where there are two prefixes; a half depends on its prefix."""
    from tests.oracle import QUERIES, compare, connect
    d = "/root/testdata/sf0.01"
    assert compare(spark, connect(d), d, f"bootstop_{name}_20")[0] == "ok"
    if name == "halves":
        h = QUERIES["bootstop_halves_20"](spark, d)
        assert h.count() == 20 * (50 + 100)
        assert h.groupBy("perm", "tree_no").agg(F.countDistinct("half").alias("n")).where("n = 2").count() > 0


def test_batches_of_trees_give_the_counts_of_single_ones():
    from cladeframe.operators import halves as H
    rng = np.random.default_rng(4)
    trees = [sorted({"".join(map(str, rng.integers(0, 2, 6))) for _ in range(3)}) for _ in range(60)]
    one, all_ = H.HalfCounts(range(3, 9), 6, 2), H.HalfCounts(range(3, 9), 6, 2)
    for i, s in enumerate(trees):
        one.add(i, s)
    all_.add_all(0, trees[:37])
    all_.add_all(37, trees[37:])
    for a, b in zip(one.counts(), all_.counts()):
        assert list(map(list, a)) == list(map(list, b)) if not isinstance(a, list) else a == b
    room, n = 3, np.concatenate(one.counts()[1:], axis=1)
    for (perm, half, kept), c in zip(one.consensus(60), [c for p in range(6) for c in (p, p + 6)]):
        names, taken = one.counts()[0], []
        for i in sorted(range(len(names)), key=lambda i: (-n[i, c], names[i])):
            if len(taken) < room and (n[i, c] > 15 or all(nw.compatible(np.array([nw.bits(names[j])]), nw.bits(names[i])).all() for j in taken)):
                taken.append(i)
        assert sorted(kept) == sorted((names[i], int(n[i, c])) for i in taken)


def test_tree_taxa_are_dealt_by_number_of_tips(spark, monkeypatch):
    from cladeframe.operators import checks
    rows = [(1, "a"), (1, "a"), (1, "b"), (1, None), (2, "c"), (2, "x"), (3, "a"), (3, "b"), (3, "c")]
    tips = spark.createDataFrame(rows, "tree_id BIGINT, label STRING")
    taxa = spark.createDataFrame([("a",), ("b",), ("c",)], "label STRING")
    monkeypatch.setattr(checks, "TIPS_A_TASK", 1)
    found = checks.tree_taxa_mismatch(tips, taxa)
    assert found.rdd.getNumPartitions() == len(rows)
    want = {(1, "a", "duplicate"), (1, None, "unknown"), (1, "c", "missing"), (2, "x", "unknown"), (2, "a", "missing"), (2, "b", "missing")}
    assert {tuple(r) for r in found.collect()} == want
    assert {tuple(r) for r in checks.tree_taxa_mismatch(tips, taxa, once=True).collect()} == want - {(1, "a", "duplicate")}


def test_distances_of_repeated_topologies_are_looked_up(spark):
    """Trees of few topologies, one of them without splits, with text ids; pairs leave the tasks as Arrow columns."""
    held = [["s1", "s2"], ["s1", "s3"], []]
    ids = [f"t{k:03d}" for k in range(90)]
    t = spark.createDataFrame([(x,) for x in ids], "tree_id STRING")
    s = spark.createDataFrame([(x, c) for k, x in enumerate(ids) for c in held[k % 3]], "tree_id STRING, split STRING")
    df = TS.rf_pairwise(s, t, 7, 16)
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().toString()
    got = {(r["tree_i"], r["tree_j"]): r["rf"] for r in df.collect()}
    assert got == {(ids[i], ids[j]): len(set(held[i % 3]) ^ set(held[j % 3])) for i in range(90) for j in range(i + 1, 90)}


def test_chunks_hold_few_topologies_and_trees():
    assert TS.chunks([], 8, 2) == ([], 0)
    assert TS.chunks([(1, 3, 1), (2, 5, 1), (3, 1, 1), (5, 17, 2), (8, 2, 1), (9, 2, 2)], 8, 2) == (
        [(1, 0, 1), (2, 0, 1), (3, 1, 1), (5, 2, 3), (8, 5, 1), (9, 6, 1)], 7)


@pytest.mark.parametrize("kind", ["STRING", "BIGINT"])
def test_pairs_leave_python_as_rows_of_many(spark, monkeypatch, kind):
    """One topology of most trees, cut into several chunks, some of one tree, trees without splits, ids that are missing or come twice."""
    monkeypatch.setattr(TS, "PAIRS_AT_ONCE", 24)
    held = [["s0", "s1"]] * 40 + [[f"s{k}", f"s{k + 1}"] for k in range(1, 12)] + [[]] * 9
    ids = [f"é{k * 7 % 60}" if kind == "STRING" else k * 7 % 60 - 30 for k in range(60)]
    t = spark.createDataFrame([(x,) for x in ids] + [(None,), (None,), (ids[3],)], f"tree_id {kind}").repartition(5)
    s = spark.createDataFrame([(x, c) for x, h in zip(ids, held) for c in h], f"tree_id {kind}, split STRING")
    of = [*zip(ids, held), (None, []), (None, []), (ids[3], held[3])]
    key = lambda x: (x is None, x if kind == "BIGINT" else (x or "").encode())
    want = collections.Counter(
        (*sorted((a, b), key=key), len(set(p) ^ set(q)), len(set(p) ^ set(q)) / 8) for (a, p), (b, q) in itertools.combinations(of, 2))
    for block in (2, 512):
        df = TS.rf_pairwise(s, t, 7, block)
        assert df.schema.simpleString() == f"struct<tree_i:{kind.lower()},tree_j:{kind.lower()},rf:bigint,rrf:double>"
        assert collections.Counter(tuple(r) for r in df.collect()) == want
        made = df._jdf.queryExecution().toString()
        assert "posexplode(right" in made and "FlatMapGroupsInArrow" in made  # generated code makes the pairs
    assert TS.rf_pairwise(s, t.limit(0), 7).count() == 0 and TS.rf_pairwise(s, t.limit(1), 7).count() == 0
