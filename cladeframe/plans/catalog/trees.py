"""Registered queries over trees and tree sets derived from the tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from cladeframe.operators import checks, halves as H, trees as T, treesets as TS
from cladeframe.plans import recipes as R
from cladeframe.plans.catalog import sql as S
from cladeframe.session import shared_dir

Q: dict = {}
O: dict = {}


def query(oracle: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if oracle:
            O[fn.__name__] = oracle
        return fn
    return add


def r6(c):
    return F.round(c, 6)


NATIONS = [f"N{i}" for i in range(25)]
LINES = [f"N{i}" for i in range(7)]


def newick_of(counts, length=None):
    ranked = R.ladders(counts).withColumn("label", F.concat(F.lit("N"), F.col("taxon_id").cast("string")))
    return R.ladder_newick(ranked, "label", length=length)


def segment_trees(spark, d):
    return newick_of(R.segment_year_counts(spark, d))


def month_trees(spark, d):
    return newick_of(R.month_out_counts(spark, d))


def supplier_trees(spark, d):
    return newick_of(R.supplier_counts(spark, d))


def part_trees(spark, d):
    return newick_of(R.supplier_counts(spark, d, "l_partkey"))


def splits(trees, labels):
    return T.tree_splits(trees, labels).select("tree_id", "split")


SEG = f"{S.SEG_COUNTS}, {S.ladder_splits()}"
MON = f"{S.MONTH_COUNTS}, {S.ladder_splits()}"
SUP = f"{S.line_counts('l_suppkey')}, {S.ladder_splits(n=7)}"
PART = f"{S.line_counts('l_partkey')}, {S.ladder_splits(n=7)}"
_RF = """k AS (SELECT tree_id, count(*) AS c FROM splits GROUP BY 1),
sh AS (SELECT a.tree_id AS tree_i, b.tree_id AS tree_j, count(*) AS s FROM splits a JOIN splits b USING (split) WHERE a.tree_id < b.tree_id GROUP BY 1,2),
rf AS (SELECT a.tree_id AS tree_i, b.tree_id AS tree_j, (a.c + b.c - 2 * coalesce(s, 0))::BIGINT AS rf
  FROM k a JOIN k b ON a.tree_id < b.tree_id LEFT JOIN sh ON tree_i = a.tree_id AND tree_j = b.tree_id)"""
_UNIQ = "(SELECT count(DISTINCT t)::BIGINT FROM (SELECT string_agg(split, ',' ORDER BY split) AS t FROM splits GROUP BY tree_id))"


@query(f"WITH {SEG} SELECT tree_id, split FROM splits")
def splits_of_tree(spark, d):
    return splits(segment_trees(spark, d), NATIONS)


@query(f"WITH {PART} SELECT tree_id, split FROM splits")
def splits_of_many_trees(spark, d):
    return splits(part_trees(spark, d), LINES)


@query(f"WITH {SUP}, {_RF} SELECT tree_i, tree_j, rf, round(rf/8.0,6)::DOUBLE AS rrf FROM rf")
def rf_pairwise(spark, d):
    t = supplier_trees(spark, d)
    return TS.rf_pairwise(splits(t, LINES), t, 7)  # eighths: no rounding changes them


@query(f"WITH {SEG}, {_RF} SELECT tree_i, tree_j, rf, round(rf/44.0,6)::DOUBLE AS rrf FROM rf")
def rf_relative(spark, d):
    t = segment_trees(spark, d)
    r = TS.rf_pairwise(splits(t, NATIONS), t, 25)
    return r.select("tree_i", "tree_j", "rf", r6("rrf").alias("rrf"))


@query(f"WITH {SUP}, {_RF} SELECT round(avg(rf),6) AS avg_rf, round(avg(rf)/8.0,6) AS avg_rrf, {_UNIQ} AS unique_trees FROM rf")
def rf_average(spark, d):
    t = supplier_trees(spark, d)
    r = TS.rf_average(t, LINES)
    return r.select(r6("avg_rf").alias("avg_rf"), r6("avg_rrf").alias("avg_rrf"), "unique_trees")


@query(f"""WITH {PART}, c AS (SELECT split, count(*)::DOUBLE AS n FROM splits GROUP BY 1), t AS (SELECT count(DISTINCT tree_id)::DOUBLE AS t FROM splits),
a AS (SELECT ((SELECT sum(n) FROM c) * (t - 1) - (SELECT sum(n * (n - 1)) FROM c)) / (t * (t - 1) / 2) AS avg_rf FROM t)
SELECT round(avg_rf, 6) AS avg_rf, round(avg_rf / 8, 6) AS avg_rrf, {_UNIQ} AS unique_trees FROM a""")
def rf_lowmem(spark, d):
    t = part_trees(spark, d)
    r = TS.rf_average(t, LINES)
    return r.select(r6("avg_rf").alias("avg_rf"), r6("avg_rrf").alias("avg_rrf"), "unique_trees")


@query(f"WITH {PART} SELECT {_UNIQ} AS unique_trees")
def rf_unique(spark, d):
    t = part_trees(spark, d)
    return TS.unique_topologies(splits(t, LINES), t)


@query(f"WITH {SEG} SELECT DISTINCT split FROM splits")
def split_union(spark, d):
    return TS.all_splits(splits(segment_trees(spark, d), NATIONS))


@query(f"""WITH {SEG}, a AS (SELECT split, count(*) AS n FROM splits WHERE tree_id < 'D' GROUP BY 1),
b AS (SELECT split, count(*) AS n FROM splits WHERE tree_id >= 'D' GROUP BY 1)
SELECT split, abs(coalesce(a.n,0) - coalesce(b.n,0))::BIGINT AS diff FROM a FULL JOIN b USING (split)""")
def split_merge_diff(spark, d):
    s = splits(segment_trees(spark, d), NATIONS)
    a = TS.split_counts(s.where("tree_id < 'D'")).withColumnRenamed("n", "a")
    b = TS.split_counts(s.where("tree_id >= 'D'")).withColumnRenamed("n", "b")
    return a.join(b, "split", "full").select("split", F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("diff"))


@query(f"""WITH {SEG}, c AS (SELECT split, row_number() OVER (ORDER BY count(*) DESC, split) AS rank, count(*)::BIGINT AS n FROM splits GROUP BY 1)
SELECT split, n, rank FROM c WHERE rank <= 22""")
def topk_splits(spark, d):
    """The n-3 best supported splits: a top-k report, ranked after the limit."""
    from pyspark.sql import Window
    c = TS.split_counts(splits(segment_trees(spark, d), NATIONS))
    top = c.orderBy(F.col("n").desc(), "split").limit(22)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "split")).cast("bigint"))


_REF = f"""ref0 AS (SELECT taxon_id, sum(n)::BIGINT AS n FROM counts GROUP BY 1),
refc AS (SELECT 0 AS tree_id, taxon_id, n FROM ref0), {S.ladder_splits('ref', 'refc')}"""


def _reference(spark, d):
    return newick_of(R.overall_counts(spark, d))


@query(f"""WITH {SEG}, {_REF}, t AS (SELECT count(DISTINCT tree_id) AS t FROM counts),
x AS (SELECT split, (SELECT count(*) FROM splits s WHERE s.split = ref.split)::DOUBLE / t AS f FROM ref, t)
SELECT split, round(f, 6) AS support, floor(f * 100 + 0.5)::BIGINT AS percent FROM x""")
def support_fbp(spark, d):
    t = segment_trees(spark, d)
    r = TS.support_fbp(splits(_reference(spark, d), NATIONS), splits(t, NATIONS), trees=t)
    return r.select("split", r6("support").alias("support"), "percent")


_HAM = "length(replace(list_aggregate(list_transform(range(1, 26), lambda i: CASE WHEN r.split[i] = s.split[i] THEN '0' ELSE '1' END), 'string_agg', ''), '0', ''))"


@query(f"""WITH {SEG}, {_REF}, d AS (SELECT r.split, s.tree_id, min(least({_HAM}, 25 - {_HAM})) AS d FROM ref r CROSS JOIN splits s GROUP BY 1,2),
p AS (SELECT split, tree_id, d, least(length(replace(split,'0','')), length(replace(split,'1',''))) AS p FROM d)
SELECT split, round(1 - avg(least(d, p - 1)) / (p - 1), 6) AS support FROM p GROUP BY split, p""")
def support_tbe(spark, d):
    ref = [r.split for r in splits(_reference(spark, d), NATIONS).collect()]
    t = segment_trees(spark, d)
    r = TS.support_tbe(ref, splits(t, NATIONS), t)
    return r.select("split", r6("support").alias("support"))


def labelled_splits(drawn, labels):
    """(split, label) of the inner nodes of a tree that was drawn as text."""
    return T.tree_splits(drawn.select(F.lit(0).alias("tree_id"), "newick"), labels).select("split", "label")


@query(f"""WITH {SEG}, {_REF}, t AS (SELECT count(DISTINCT tree_id) AS t FROM counts)
SELECT split, floor((SELECT count(*) FROM splits s WHERE s.split = ref.split)::DOUBLE / t * 100 + 0.5)::BIGINT::VARCHAR AS label FROM ref, t""")
def support_label(spark, d):
    """Supports as they stand in the text of the reference tree."""
    t = segment_trees(spark, d)
    ref = _reference(spark, d)
    s = TS.support_fbp(splits(ref, NATIONS), splits(t, NATIONS), trees=t)
    return labelled_splits(TS.draw_support(ref.first().newick, s, NATIONS), NATIONS)


@query(f"""WITH {SEG}, {_REF}, t AS (SELECT count(DISTINCT tree_id) AS t FROM counts),
x AS (SELECT split, (SELECT count(*) FROM splits s WHERE s.split = ref.split)::DOUBLE / t AS f FROM ref, t),
d AS (SELECT r.split, s.tree_id, min(least({_HAM}, 25 - {_HAM})) AS d FROM ref r CROSS JOIN splits s GROUP BY 1,2),
p AS (SELECT split, tree_id, d, least(length(replace(split,'0','')), length(replace(split,'1',''))) AS p FROM d)
SELECT 'fbp' AS metric, split, round(f, 6) AS support FROM x
UNION ALL SELECT 'tbe', split, round(1 - avg(least(d, p - 1)) / (p - 1), 6) FROM p GROUP BY split, p""")
def support_multi(spark, d):
    t = segment_trees(spark, d)
    sp = splits(t, NATIONS)
    ref = splits(_reference(spark, d), NATIONS)
    fbp = TS.support_fbp(ref, sp, trees=t).select(F.lit("fbp").alias("metric"), "split", "support")
    tbe = TS.support_tbe([r.split for r in ref.collect()], sp, t).select(F.lit("tbe").alias("metric"), "split", "support")
    return fbp.unionByName(tbe).select("metric", "split", r6("support").alias("support"))


_CONS = "SELECT split, count(*)::BIGINT AS n, round(count(*)/12.0,6)::DOUBLE AS freq FROM splits GROUP BY 1 HAVING "


@query(f"WITH {MON} {_CONS} count(*) = 12")
def consensus_strict(spark, d):
    c = TS.consensus_splits(splits(month_trees(spark, d), NATIONS), 12, 25, "STRICT")
    return c.withColumn("freq", r6("freq"))


@query(f"WITH {MON} {_CONS} count(*) > 6")
def consensus_mr(spark, d):
    c = TS.consensus_splits(splits(month_trees(spark, d), NATIONS), 12, 25, "MR")
    return c.withColumn("freq", r6("freq"))


@query(f"WITH {MON} {_CONS} count(*) > 9")
def consensus_mr75(spark, d):
    c = TS.consensus_splits(splits(month_trees(spark, d), NATIONS), 12, 25, "MR75")
    return c.withColumn("freq", r6("freq"))


# Greedy extension as a recursive walk over the ranked candidates; the accepted list is the state.


def _fits(n: int) -> str:
    def empty(x, y):
        return ("NOT list_bool_or(list_transform(range(1, %d), lambda i: a[i] = '%s' AND c.split[i] = '%s'))" % (n + 1, x, y))
    return f"({empty('1','1')} OR {empty('1','0')} OR {empty('0','1')})"


def _mre(n: int, t: int) -> str:
    ok = _fits(n)
    return f"""cand AS (SELECT split, n, row_number() OVER (ORDER BY n DESC, split) AS rk FROM
  (SELECT split, count(*)::BIGINT AS n FROM splits GROUP BY 1)),
walk AS (SELECT 0::BIGINT AS rk, []::VARCHAR[] AS acc UNION ALL
  SELECT c.rk, CASE WHEN len(w.acc) < {n - 3} AND list_bool_and(list_concat([true], list_transform(w.acc, lambda a: {ok})))
    THEN list_append(w.acc, c.split) ELSE w.acc END FROM walk w JOIN cand c ON c.rk = w.rk + 1)
SELECT c.split, c.n, round(c.n / {t}.0, 6)::DOUBLE AS freq FROM cand c JOIN
  (SELECT unnest(acc) AS split FROM (SELECT acc FROM walk ORDER BY rk DESC LIMIT 1)) USING (split)"""


@query(f"WITH RECURSIVE {MON}, {_mre(25, 12)}")
def consensus_mre(spark, d):
    c = TS.consensus_splits(splits(month_trees(spark, d), NATIONS), 12, 25, "MRE")
    return c.withColumn("freq", r6("freq"))


@query(f"WITH RECURSIVE {PART}, {_mre(7, 1)}".replace("c.n / 1.0", "c.n::DOUBLE / (SELECT count(DISTINCT tree_id) FROM splits)"))
def consensus_mre_many(spark, d):
    t = part_trees(spark, d)
    c = TS.consensus_splits(splits(t, LINES), t.count(), 7, "MRE")
    return c.withColumn("freq", r6("freq"))


@query(f"WITH {MON} SELECT split, floor(count(*) / 12.0 * 100 + 0.5)::BIGINT::VARCHAR AS label FROM splits GROUP BY 1 HAVING count(*) > 6")
def tree_from_splits(spark, d):
    """The majority tree as text, read again: its splits with their percentages."""
    c = TS.consensus_splits(splits(month_trees(spark, d), NATIONS), 12, 25, "MR")
    return labelled_splits(TS.consensus_tree(c, NATIONS), NATIONS)


@query(f"""WITH {MON}, u AS (SELECT DISTINCT split FROM splits), r AS (SELECT split AS a FROM splits WHERE tree_id = 1),
x AS (SELECT c.split, (NOT list_bool_or(list_transform(range(1,26), lambda i: a[i]='1' AND c.split[i]='1')) OR
  NOT list_bool_or(list_transform(range(1,26), lambda i: a[i]='1' AND c.split[i]='0')) OR
  NOT list_bool_or(list_transform(range(1,26), lambda i: a[i]='0' AND c.split[i]='1'))) AS ok FROM u c CROSS JOIN r)
SELECT split, bool_and(ok) AS compatible FROM x GROUP BY 1""")
def splits_compatible(spark, d):
    """Which splits of the tree set are compatible with the first tree."""
    import numpy as np
    import pandas as pd

    from cladeframe.functions import newick as nw
    sp = splits(month_trees(spark, d), NATIONS)
    held = np.array([nw.bits(r.split) for r in sp.where("tree_id = 1").collect()])

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"split": pdf.split, "compatible": [bool(nw.compatible(held, nw.bits(s)).all()) for s in pdf.split]})

    return TS.all_splits(sp).mapInPandas(run, "split STRING, compatible BOOLEAN")


# -- convergence ------------------------------------------------------------------------

#: Permutations of the reduced queries named ``_20``; the others take the default of ``bootstop``.
PERMS = 20
ALL_PERMS = 1000


def _numbered(spark, d):
    """Supplier trees numbered in key order."""
    from cladeframe.operators.sites import dense_offsets
    t = dense_offsets(supplier_trees(spark, d), "tree_id", name="tree_no").select("tree_id", "tree_no", "newick")
    return t, splits(t, LINES).join(t.select("tree_id", "tree_no"), "tree_id").select("tree_no", "split")


_HASH = S.mix("((tree_no // 2 % 2147483647) * 48271 + perm * 69621 + 1) % 2147483647")


def _halves(perms: int) -> str:
    return f"""no AS (SELECT tree_id, row_number() OVER (ORDER BY tree_id) - 1 AS tree_no FROM (SELECT DISTINCT tree_id FROM counts)),
pf AS (SELECT unnest(list_concat(list_transform(range(0, count(*) // 50), lambda k: 50 * (k + 1)),
  CASE WHEN count(*) % 50 > 0 OR count(*) = 0 THEN [count(*)] ELSE [] END))::INTEGER AS prefix FROM no),
hv AS (SELECT tree_no, perm, (({_HASH} + tree_no) % 2)::INTEGER AS half
  FROM no CROSS JOIN (SELECT unnest(range(0,{perms}))::INTEGER AS perm))"""


def _boot(perms: int) -> str:
    """Counts are summed once per tree and step of 50, then over the steps of a prefix."""
    return f"""WITH RECURSIVE {SUP}, {_halves(perms)}, st AS (SELECT (SELECT min(prefix) FROM pf WHERE prefix > tree_no) AS step, perm, split,
  count(*) FILTER (half=0) AS n0, count(*) FILTER (half=1) AS n1 FROM hv JOIN no USING (tree_no) JOIN splits USING (tree_id) GROUP BY 1,2,3),
hs AS (SELECT prefix, perm, split, sum(n0)::BIGINT AS n0, sum(n1)::BIGINT AS n1 FROM pf JOIN st ON step <= prefix GROUP BY 1,2,3),
cand AS (SELECT *, row_number() OVER (PARTITION BY prefix, perm, half ORDER BY n DESC, split) AS rk FROM
  (SELECT prefix, perm, 0 AS half, split, n0 AS n FROM hs UNION ALL SELECT prefix, perm, 1, split, n1 FROM hs)),
walk AS (SELECT DISTINCT prefix, perm, half, 0::BIGINT AS rk, []::VARCHAR[] AS acc FROM cand UNION ALL
  SELECT c.prefix, c.perm, c.half, c.rk, CASE WHEN len(w.acc) < 4 AND (c.n > c.prefix // 4 OR
    list_bool_and(list_concat([true], list_transform(w.acc, lambda a: {_fits(7)})))) THEN list_append(w.acc, c.split) ELSE w.acc END
  FROM walk w JOIN cand c ON c.prefix = w.prefix AND c.perm = w.perm AND c.half = w.half AND c.rk = w.rk + 1),
fin AS (SELECT prefix, perm, half, unnest(arg_max(acc, rk)) AS split FROM walk GROUP BY 1,2,3),
cons AS (SELECT prefix, perm, half, split, n FROM fin JOIN cand USING (prefix, perm, half, split)),
wrf AS (SELECT prefix, perm, sum(abs(a - b))::BIGINT AS wrf, sum(k)::BIGINT AS n_splits FROM (SELECT prefix, perm, split,
  coalesce(sum(n) FILTER (half=0),0) AS a, coalesce(sum(n) FILTER (half=1),0) AS b, count(*) AS k FROM cons GROUP BY 1,2,3) GROUP BY 1,2),
conv AS (SELECT prefix AS trees, avg(wrf) AS avg_wrf, avg(wrf / (0.5 * prefix * n_splits) * 100) AS avg_pct,
  count(*) FILTER (wrf <= 0.03 * (0.5 * prefix * n_splits)) AS better, avg(0.03 * (0.5 * prefix * n_splits)) AS t FROM wrf GROUP BY 1),
verdict AS (SELECT trees, round(avg_wrf,6)::DOUBLE AS avg_wrf, round(avg_pct,6)::DOUBLE AS avg_pct, better::BIGINT AS better,
  better >= {int(0.99 * perms)} AND avg_wrf <= t AS converged FROM conv) """


_HASH_20 = S.mix("((tree_no % 2147483647) * 48271 + perm * 69621 + 1) % 2147483647")
_HALVES_20 = f"""no AS (SELECT tree_id, row_number() OVER (ORDER BY tree_id) - 1 AS tree_no FROM (SELECT DISTINCT tree_id FROM counts)),
pf AS (SELECT unnest(list_concat(list_transform(range(0, count(*) // 50), lambda k: 50 * (k + 1)),
  CASE WHEN count(*) % 50 > 0 OR count(*) = 0 THEN [count(*)] ELSE [] END))::INTEGER AS prefix FROM no),
hv AS (SELECT prefix, perm::INTEGER AS perm, tree_no, ((row_number() OVER (PARTITION BY prefix, perm ORDER BY {_HASH_20}, tree_no) - 1) % 2)::INTEGER AS half
  FROM no JOIN pf ON tree_no < prefix CROSS JOIN (SELECT unnest(range(0,{PERMS})) AS perm))"""
_SUPPORT_20 = """hs AS (SELECT prefix, perm, split, count(*) FILTER (half=0)::BIGINT AS n0, count(*) FILTER (half=1)::BIGINT AS n1
FROM hv JOIN no USING (tree_no) JOIN splits USING (tree_id) GROUP BY 1,2,3)"""


def _boot_20() -> str:
    """Halves are shuffled anew for every prefix; the rest is as in ``_boot``."""
    rest = _boot(PERMS)
    return f"WITH RECURSIVE {SUP}, {_HALVES_20}, {_SUPPORT_20},\n" + rest[rest.index("cand AS ("):]


_UNTIL = "SELECT trees, avg_wrf, avg_pct, better, converged FROM verdict WHERE trees <= coalesce((SELECT min(trees) FROM verdict WHERE converged), 1000000000)"


def _prefixes(t):
    return H.report_prefixes(t.count())


@query(f"WITH {S.line_counts('l_suppkey')}, {_HALVES_20} SELECT prefix, perm, tree_no, half FROM hv")
def bootstop_halves_20(spark, d):
    """Reduced to 20 permutations, halves shuffled anew for every prefix; so are the other queries named ``_20``."""
    t = _numbered(spark, d)[0]
    return H.shuffled_halves(t, PERMS, _prefixes(t))


@query(f"WITH {S.line_counts('l_suppkey')}, {_halves(ALL_PERMS)} SELECT tree_no, perm, half FROM hv")
def bootstop_halves(spark, d):
    return H.halves(_numbered(spark, d)[0], ALL_PERMS)


def _check(of, spark, d, perms: int):
    t, sp = _numbered(spark, d)
    return of(sp, t, 7, _prefixes(t), perms)


@query(_boot_20() + "SELECT prefix, perm, split, n0, n1 FROM hs")
def bootstop_half_support_20(spark, d):
    """Reduced to 20 permutations."""
    return _check(H.shuffled_support, spark, d, PERMS)


@query(_boot(ALL_PERMS) + "SELECT prefix, perm, split, n0, n1 FROM hs")
def bootstop_half_support(spark, d):
    return _check(H.half_support, spark, d, ALL_PERMS)


@query(_boot_20() + "SELECT prefix, perm, half, split, n FROM cons")
def bootstop_mre_20(spark, d):
    """Reduced to 20 permutations."""
    return _check(H.shuffled_consensus, spark, d, PERMS)


@query(_boot(ALL_PERMS) + "SELECT prefix, perm, half, split, n FROM cons")
def bootstop_mre(spark, d):
    return _check(H.half_consensus, spark, d, ALL_PERMS)


def _wrf(spark, d, perms: int):
    t, sp = _numbered(spark, d)
    return H.weighted_rf(H.in_blocks(sp, t, perms), 7, _prefixes(t), perms)


@query(_boot_20() + "SELECT prefix, perm, wrf, n_splits FROM wrf")
def bootstop_wrf_20(spark, d):
    """Reduced to 20 permutations."""
    return _check(H.shuffled_rf, spark, d, PERMS)


@query(_boot(ALL_PERMS) + "SELECT prefix, perm, wrf, n_splits FROM wrf")
def bootstop_wrf(spark, d):
    return _wrf(spark, d, ALL_PERMS)


def _rounded(report):
    return report.withColumn("avg_wrf", r6("avg_wrf")).withColumn("avg_pct", r6("avg_pct"))


@query(_boot_20() + "SELECT trees, avg_wrf, avg_pct, better, converged FROM verdict")
def bootstop_converged_20(spark, d):
    """Reduced to 20 permutations."""
    return _rounded(_check(H.shuffled_bootstop, spark, d, PERMS))


@query(_boot(ALL_PERMS) + "SELECT trees, avg_wrf, avg_pct, better, converged FROM verdict")
def bootstop_converged(spark, d):
    return _rounded(_check(H.bootstop, spark, d, ALL_PERMS))


@query(_boot_20() + _UNTIL)
def bootstop_report_20(spark, d):
    """Reduced to 20 permutations."""
    return _rounded(H.until_converged(_check(H.shuffled_bootstop, spark, d, PERMS)))


@query(_boot(ALL_PERMS) + _UNTIL)
def bootstop_report(spark, d):
    return _rounded(_check(H.report, spark, d, ALL_PERMS))


@query(_boot(ALL_PERMS) + _UNTIL.replace("FROM verdict WHERE", "FROM verdict WHERE trees % 50 = 0 AND"))
def bootstop_online(spark, d):
    """Supplier trees as a stream of small files; the check at every 50 trees stops at the first that converges."""
    from cladeframe.streaming.convergence import watch
    t, _ = _numbered(spark, d)
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    t = t.select("tree_no", "newick").withColumn("file", F.floor(F.col("tree_no") / 80).cast("int"))
    files = max(1, math.ceil(t.count() / 80))
    # files are taken by their age; written in the order of the trees, few trees have to wait for their turn
    t.repartitionByRange(files, "file").sortWithinPartitions("file", "tree_no").write.option("maxRecordsPerFile", 80).parquet(f"{path}/trees")
    # a batch is a share of what has come, so their number doesn't grow with the stream
    stream = spark.readStream.schema("tree_no BIGINT, newick STRING").option("maxFilesPerTrigger", max(4, math.ceil(files / 32))).parquet(f"{path}/trees")
    found = watch(stream, LINES, f"{path}/run").wait()
    return _rounded(found if found is not None else spark.createDataFrame([], H.REPORT))


# -- single-tree operators --------------------------------------------------------------

@query(f"""WITH {S.SEG_COUNTS} SELECT tree_id, count(*)::BIGINT AS tips, count(*)::BIGINT - 2 AS inner_nodes, 2*count(*)::BIGINT - 3 AS branches,
count(*)::BIGINT - 3 AS splits, true AS is_binary FROM counts GROUP BY 1""")
def tree_counts(spark, d):
    return T.tree_shape(segment_trees(spark, d))


def _region_tree(spark, d):
    """Region -> nation hierarchy weighted by orders: one multifurcating tree per order year."""
    o = R.table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("bigint").alias("tree_id"))
    c = R.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = R.table(spark, d, "nation")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy("tree_id", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    j = g.join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    inner = j.groupBy("tree_id", "n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))), ",").alias("t"), F.count(F.lit(1)).alias("k"))
    clade = F.when(F.col("k") > 1, F.concat(F.lit("("), "t", F.lit(")"))).otherwise(F.col("t"))
    return inner.groupBy("tree_id").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(clade)), ","), F.lit(");")).alias("newick"))


@query("""WITH j AS (SELECT DISTINCT year(o_orderdate) AS tree_id, n_regionkey, c_nationkey FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON n_nationkey=c_nationkey),
k AS (SELECT tree_id, n_regionkey, count(*) AS k FROM j GROUP BY 1,2)
SELECT tree_id, sum(k)::BIGINT AS tips, (max(k) FILTER (k > 1) <= 2 AND count(*) = 3) AS is_binary FROM k GROUP BY 1""")
def tree_is_binary(spark, d):
    return T.tree_shape(_region_tree(spark, d)).select("tree_id", "tips", "is_binary")


@query(f"""WITH {S.line_counts('l_suppkey')}, r AS (SELECT tree_id, taxon_id, n, row_number() OVER (PARTITION BY tree_id ORDER BY n DESC, taxon_id) AS rk FROM counts)
SELECT tree_id, 'N' || taxon_id AS label, CASE WHEN rk = 7 THEN n + 0.05 ELSE n END::DOUBLE AS length FROM r""")
def tip_labels(spark, d):
    counts = R.supplier_counts(spark, d).withColumn("len", F.col("n").cast("double"))
    ranked = R.ladders(counts).withColumn("label", F.concat(F.lit("N"), F.col("taxon_id").cast("string"))).withColumn(
        "len", F.col("n").cast("double"))
    return T.tree_tips(R.ladder_newick(ranked, "label", length="len"))


@query(f"""WITH {S.line_counts('l_suppkey')}, r AS (SELECT tree_id, taxon_id, row_number() OVER (PARTITION BY tree_id ORDER BY n DESC, taxon_id) AS rk FROM counts),
l AS (SELECT tree_id, list('N' || taxon_id ORDER BY rk) AS l FROM r GROUP BY 1)
SELECT tree_id, '(' || '((((' || l[1] || ':0.100000,' || l[2] || ':0.100000):0.100000,' || l[3] || ':0.100000):0.100000,' || l[4] || ':0.100000):0.100000,' || l[5] || ':0.100000):0.100000,' ||
l[6] || ':0.100000,' || l[7] || ':0.100000);' AS newick FROM l""")
def fix_missing_brlens(spark, d):
    return T.fill_lengths(supplier_trees(spark, d))


@query(f"""WITH {S.line_counts('l_suppkey')}, r AS (SELECT tree_id, taxon_id, row_number() OVER (PARTITION BY tree_id ORDER BY n DESC, taxon_id) AS rk FROM counts),
l AS (SELECT tree_id, list('N' || taxon_id ORDER BY rk) AS l FROM r GROUP BY 1)
SELECT tree_id, '(' || '((((' || l[1] || ',' || l[2] || '),' || l[3] || '),' || l[4] || '),' || l[5] || '),' || l[6] || ',' || l[7] || ');' AS newick FROM l""")
def topology_extract(spark, d):
    return T.topology_only(supplier_trees(spark, d))


@query(f"""WITH {SUP} SELECT tree_id, split, 0.25::DOUBLE AS length FROM splits""")
def reset_brlens(spark, d):
    """Trees with lengths get one for all branches; their splits stay."""
    counts = R.ladders(R.supplier_counts(spark, d)).withColumn("label", F.concat(F.lit("N"), F.col("taxon_id").cast("string"))).withColumn(
        "len", F.col("n").cast("double"))
    return T.tree_splits(T.fill_lengths(R.ladder_newick(counts, "label", length="len"), 0.25, everywhere=True), LINES).select("tree_id", "split", "length")


@query("""WITH e AS (SELECT l_suppkey AS tree_id, l_linenumber - 1 AS taxon_id, CASE WHEN l_returnflag='A' THEN 0 WHEN l_returnflag='N' THEN 1 ELSE 2 END AS part_id, avg(l_discount) AS length
FROM lineitem GROUP BY 1,2,3), s AS (SELECT CASE WHEN l_returnflag='A' THEN 0 WHEN l_returnflag='N' THEN 1 ELSE 2 END AS part_id, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1)
SELECT tree_id, taxon_id::BIGINT AS taxon_id, round(sum(length*w)/sum(w), 6) AS length FROM e JOIN s USING (part_id) GROUP BY 1,2""")
def avg_brlens(spark, d):
    li = R.table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_discount")
    part = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("part_id")
    e = li.groupBy(F.col("l_suppkey").alias("tree_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("taxon_id"), part).agg(
        F.avg("l_discount").alias("length"))
    s = li.groupBy(part).agg(F.count(F.lit(1)).cast("double").alias("share"))
    return T.average_lengths(e, s).withColumn("length", r6("length"))


@query("""SELECT l_suppkey AS tree_id, l_linenumber::BIGINT AS edge, round(avg(l_tax),6) AS length FROM lineitem GROUP BY 1,2""")
def apply_partition_brlens(spark, d):
    li = R.table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_discount", "l_tax")
    e = li.groupBy(F.col("l_suppkey").alias("tree_id"), F.col("l_linenumber").cast("bigint").alias("edge")).agg(
        F.array(F.avg("l_discount"), F.avg("l_tax")).alias("brlens"))
    return T.partition_lengths(e, 1).withColumn("length", r6("length"))


@query(f"""WITH {SUP}, b AS (SELECT tree_id, bool_or(split IN ('0110000', '1001111')) AS monophyletic FROM splits GROUP BY 1)
SELECT tree_id, monophyletic, split FROM b JOIN splits USING (tree_id)""")
def reroot_outgroup(spark, d):
    """The flag, and the splits of the tree as it is written after rooting: they are those before."""
    r = T.reroot(supplier_trees(spark, d), ["N1", "N2"])
    return r.select("tree_id", "monophyletic").join(splits(r, LINES), "tree_id")


@query("SELECT s_suppkey AS tree_id, 25::BIGINT AS tips, true AS is_binary FROM supplier")
def tree_random(spark, d):
    ids = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tree_id"))
    return T.tree_shape(T.random_trees(ids, NATIONS, seed=3)).select("tree_id", "tips", "is_binary")


@query("SELECT s_suppkey AS tree_id, 1::BIGINT AS kept FROM supplier")
def tree_random_constrained(spark, d):
    """Random trees under a constraint: every one keeps the constrained split."""
    ids = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tree_id"))
    t = T.random_trees(ids, LINES, seed=3, constraint="((N4,N5,N6),N0,N1);")
    keep = splits(t, LINES).withColumn("inside", F.regexp_replace("split", r"^(..)..(...)$", "$1$2"))
    return keep.where("inside = '00111'").groupBy("tree_id").agg(F.countDistinct("inside").alias("kept"))


@query(f"""WITH {S.line_counts('l_suppkey')} SELECT c.tree_id, 'N' || taxon_id AS label, CASE WHEN taxon_id < 5 THEN r_regionkey::BIGINT END AS taxon_id
FROM counts c LEFT JOIN region ON r_regionkey = taxon_id""")
def tip_id_normalise(spark, d):
    taxa = R.table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("taxon_id"),
                                               F.concat(F.lit("N"), F.col("r_regionkey").cast("string")).alias("label"))
    return T.normalise_tips(T.tree_tips(supplier_trees(spark, d)), taxa).select("tree_id", "label", "taxon_id")


@query("""WITH have AS (SELECT DISTINCT l_orderkey AS t, 'N' || (l_linenumber-1) AS label FROM lineitem),
taxa AS (SELECT 'N' || r_regionkey AS label FROM region)
SELECT t AS tree_id, label, 'unknown' AS problem FROM have WHERE label NOT IN (SELECT label FROM taxa)
UNION ALL SELECT t, x.label, 'missing' FROM (SELECT DISTINCT t FROM have) CROSS JOIN taxa x WHERE (t, x.label) NOT IN (SELECT t, label FROM have)""")
def check_tree_taxa(spark, d):
    li = R.table(spark, d, "lineitem")
    tips = li.select(F.col("l_orderkey").alias("tree_id"), F.concat(F.lit("N"), (F.col("l_linenumber") - 1).cast("string")).alias("label"))
    taxa = R.table(spark, d, "region").select(F.concat(F.lit("N"), F.col("r_regionkey").cast("string")).alias("label"))
    return checks.tree_taxa_mismatch(tips, taxa, once=True)


@query("SELECT DISTINCT 'P' || l_partkey AS label FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def check_outgroup(spark, d):
    out = R.table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("label")).distinct()
    taxa = R.table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("label"))
    return checks.unknown_outgroup(out, taxa)


@query("SELECT DISTINCT 'C' || o_custkey AS label FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def check_constraint(spark, d):
    tips = R.table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("label"))
    taxa = R.table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("label"))
    return checks.unknown_constraint_taxa(tips, taxa)


@query("SELECT o_orderkey AS tree_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def done_trees_minus(spark, d):
    todo = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("tree_id"))
    done = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tree_id"))
    return T.remaining(todo, done)


@query("SELECT o_orderkey AS tree_id, -o_totalprice AS loglh, o_orderpriority AS newick FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def best_tree(spark, d):
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("tree_id"), (-F.col("o_totalprice")).alias("loglh"),
                                           F.col("o_orderpriority").alias("newick"))
    return T.best_tree(o)


@query("""SELECT tree_id, loglh, newick FROM (SELECT o_custkey AS cust, o_orderkey AS tree_id, -o_totalprice AS loglh, o_orderpriority AS newick,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1""")
def best_ml_trees(spark, d):
    o = R.table(spark, d, "orders")
    key = F.struct(-F.col("o_totalprice"), -F.col("o_orderkey"))
    g = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", key).alias("tree_id"), F.max(-F.col("o_totalprice")).alias("loglh"),
                                   F.max_by("o_orderpriority", key).alias("newick"))
    return g.select("tree_id", "loglh", "newick")


@query(f"WITH {SUP} SELECT tree_id, split FROM splits")
def sql_newick_splits(spark, d):
    """Splits of supplier trees by the table function, joined laterally in SQL."""
    from cladeframe.functions.registered import register
    register(spark)
    return spark.sql("SELECT t.tree_id, s.split FROM {t} t, LATERAL newick_splits(t.newick, {taxa}) s", t=supplier_trees(spark, d), taxa=",".join(LINES))
