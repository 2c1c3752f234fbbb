"""Registered queries on information criteria, planning and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import balance as B, checks, likelihood as L, profiling as P, scoring as K, sites
from cladeframe.functions import states
from cladeframe.functions.models import parse_model
from cladeframe.plans import recipes as R
from cladeframe.plans.catalog import sql as S
from cladeframe.plans.catalog.likelihoods import LABELS, LINE_MASKS, TREE, _JC, _SITE

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


# -- information criteria ---------------------------------------------------------------

@query(f"""WITH {LINE_MASKS}, {_JC}, x AS (SELECT part_id, sum(weight * {_SITE}) AS l, sum(weight)::DOUBLE AS n FROM f GROUP BY 1)
SELECT part_id, round(22 - 2*l, 4) AS aic, round(22 - 2*l + 22*12/greatest(n - 12, 1), 4) AS aicc, round(ln(n)*11 - 2*l, 4) AS bic FROM x""")
def ic_scores(spark, d):
    """Criteria of the fixed-topology JC model: 11 branches are its only free parameters."""
    p = sites.compress_patterns(R.line_sites(spark, d))
    lnl = L.pattern_loglh(p, LABELS, TREE, parse_model("JC")).groupBy("part_id").agg(
        F.sum(F.col("weight") * F.col("loglh")).alias("loglh"), F.sum("weight").alias("sites"))
    out = K.ic_scores(lnl.withColumn("free_params", F.lit(11)))
    return out.select("part_id", *[F.round(c, 4).alias(c) for c in ("aic", "aicc", "bic")])


_ORD = "SELECT o_orderkey, -o_totalprice AS l, count(l_orderkey) AS k, coalesce(sum(l_quantity), 0) + 1 AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1,2"


def _fits(spark, d):
    """One 'fit' per order: likelihood -totalprice, one parameter per line, quantity + 1 columns."""
    li = R.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"), F.sum("l_quantity").alias("q"))
    o = R.table(spark, d, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("loglh"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "loglh", F.coalesce("k", F.lit(0)).alias("k"), (F.coalesce("q", F.lit(0.0)) + 1).alias("n"))


@query(f"SELECT o_orderkey, round(2*k - 2*l, 4) AS aic FROM ({_ORD})")
def ic_aic(spark, d):
    return _fits(spark, d).select("o_orderkey", F.round(K.aic(F.col("loglh"), F.col("k")), 4).alias("aic"))


@query(f"SELECT o_orderkey, round(2*k - 2*l + 2*k*(k+1)/greatest(n-k-1, 1), 4) AS aicc FROM ({_ORD})")
def ic_aicc(spark, d):
    return _fits(spark, d).select("o_orderkey", F.round(K.aicc(F.col("loglh"), F.col("k"), F.col("n")), 4).alias("aicc"))


@query(f"SELECT o_orderkey, round(ln(n)*k - 2*l, 4) AS bic FROM ({_ORD})")
def ic_bic(spark, d):
    return _fits(spark, d).select("o_orderkey", F.round(K.bic(F.col("loglh"), F.col("k"), F.col("n")), 4).alias("bic"))


# -- parameters and model checks --------------------------------------------------------

_PARAMS = {"Brand#1": "GTR+G", "Brand#2": "JC", "Brand#3": "HKY+FC", "Brand#4": "GTR+FO+I+R4"}
_K = {b: parse_model(m).free_params() for b, m in _PARAMS.items()}
_CASE = "CASE p_brand WHEN 'Brand#1' THEN 9 WHEN 'Brand#2' THEN 0 WHEN 'Brand#3' THEN 4 WHEN 'Brand#4' THEN 15 ELSE 8 END"


def _brand_params(spark, d):
    """Parts as partitions whose model depends on the brand (GTR unless listed)."""
    pairs = [F.lit(x) for b, k in _K.items() for x in (b, k)]
    k = F.coalesce(F.element_at(F.create_map(*pairs), F.col("p_brand")), F.lit(parse_model("GTR").free_params()))
    return R.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("part_id"), "p_brand", "p_size", k.cast("bigint").alias("model_params"))


@query(f"SELECT p_brand, sum({_CASE})::BIGINT AS free_params FROM part GROUP BY 1")
def free_params(spark, d):
    return _brand_params(spark, d).groupBy("p_brand").agg(F.sum("model_params").alias("free_params"))


@query(f"""WITH b AS (SELECT p_brand, count(*) AS p, sum({_CASE}) AS k FROM part GROUP BY 1)
SELECT p_brand, (k + 11)::BIGINT AS linked, (k + 11 + p - 1)::BIGINT AS scaled, (k + 11 * p)::BIGINT AS unlinked FROM b""")
def total_free_params(spark, d):
    g = _brand_params(spark, d).groupBy("p_brand").agg(F.sum("model_params").alias("k"), F.count(F.lit(1)).alias("p"))
    b = F.lit(11)
    return g.select("p_brand", *[(F.col("k") + K.branch_params(b, F.col("p"), m)).alias(m) for m in ("linked", "scaled", "unlinked")])


@query(f"""WITH x AS (SELECT p_partkey::INTEGER AS part_id, {_CASE}::BIGINT AS model_params, p_size AS site_count FROM part)
SELECT part_id, CASE WHEN model_params >= site_count THEN 'error' ELSE 'warning' END AS verdict FROM x WHERE model_params + 11 >= site_count""")
def check_overfit(spark, d):
    p = _brand_params(spark, d).withColumn("free_params", F.col("model_params") + 11).withColumnRenamed("p_size", "site_count")
    return checks.overfit(p).select("part_id", "verdict")


@query(f"""WITH {S.VECTOR_CELLS}, v AS (SELECT part_id, site, min(state) = max(state) AS inv FROM vcells GROUP BY 1,2),
e AS (SELECT 100 AS part_id, user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS site, count(DISTINCT event_type) = 5 AS inv FROM events GROUP BY 1,2)
SELECT part_id, count(*) FILTER (inv)::BIGINT AS inv_count FROM (SELECT * FROM v UNION ALL SELECT * FROM e) GROUP BY 1 HAVING count(*) FILTER (inv) > 0""")
def check_ascbias_invariant(spark, d):
    v = sites.part_stats(sites.compress_patterns(R.vector_sites(spark, d)))
    e = sites.part_stats(sites.compress_patterns(R.event_sites(spark, d)), states.binary()).withColumn("part_id", F.lit(100))
    return checks.ascbias_invariant(v.unionByName(e))


@query("""WITH c AS (SELECT p_brand AS part_id, p_type AS state, sum(p_size)::DOUBLE AS n FROM part GROUP BY 1,2),
f AS (SELECT part_id, state, n / sum(n) OVER (PARTITION BY part_id) AS freq FROM c)
SELECT part_id, state, round(freq, 6) AS freq FROM f WHERE freq < 0.12""")
def check_zero_freqs(spark, d):
    p = R.table(spark, d, "part")
    n = p.groupBy(F.col("p_brand").alias("part_id"), F.col("p_type").alias("state")).agg(F.sum("p_size").alias("n"))
    t = n.groupBy("part_id").agg(F.sum("n").alias("t"))
    f = n.join(t, "part_id").select("part_id", "state", (F.col("n") / F.col("t")).alias("freq"))
    return checks.zero_freqs(f, 0.12).withColumn("freq", r6("freq"))


@query("""SELECT l_suppkey AS part_id, round(sum(l_discount), 6) AS total FROM lineitem GROUP BY 1 HAVING abs(sum(l_discount) - 1) > 0.01""")
def check_user_freqs_sum(spark, d):
    f = R.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("part_id"), F.col("l_discount").alias("freq"))
    return checks.user_freqs_off(f).withColumn("total", r6("total"))


@query("""WITH s AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1,2)
SELECT sum(n)::BIGINT AS total, max(n)::BIGINT AS most, min(n)::BIGINT AS least FROM k""")
def reduce_sum(spark, d):
    k = R.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return k.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least"))


# -- load balance -----------------------------------------------------------------------

PROCS = 16


def _sizes(spark, d):
    """Parts as partitions: columns from size and price, weight by type."""
    p = R.table(spark, d, "part")
    w = F.when(F.col("p_type") == "ECONOMY", 80.0).when(F.col("p_type") == "SMALL", 20.0).otherwise(16.0)
    return p.select(F.col("p_partkey").cast("int").alias("part_id"), F.lit(0).cast("bigint").alias("start"),
                    (F.col("p_size") * 100 + F.col("p_partkey") % 97).cast("bigint").alias("length"), w.alias("per_site_weight"))


_SIZES = """ps AS (SELECT p_partkey::INTEGER AS part_id, 0::BIGINT AS start, (p_size * 100 + p_partkey % 97)::BIGINT AS length,
  CASE p_type WHEN 'ECONOMY' THEN 80.0 WHEN 'SMALL' THEN 20.0 ELSE 16.0 END::DOUBLE AS w FROM part), procs AS (SELECT unnest(range(0, 16))::INTEGER AS proc)"""
_NAIVE = f"""{_SIZES}, naive AS (SELECT proc, part_id, (start + proc * (length // 16))::BIGINT AS start,
  CASE WHEN proc = 15 THEN length - 15 * (length // 16) ELSE length // 16 END::BIGINT AS length, w FROM ps CROSS JOIN procs)"""


@query(f"WITH {_NAIVE} SELECT proc, part_id, start, length FROM naive")
def lb_naive(spark, d):
    return B.equal_chunks(_sizes(spark, d), PROCS)


@query(f"""WITH {_SIZES}, o AS (SELECT *, sum(length) OVER (ORDER BY length, part_id) - length AS off, sum(length) OVER () AS n FROM ps),
x AS (SELECT proc, part_id, start, off, greatest(off, proc * n // 16) AS a, least(off + length, (proc + 1) * n // 16) AS b FROM o CROSS JOIN procs)
SELECT proc, part_id, (start + a - off)::BIGINT AS start, (b - a)::BIGINT AS length FROM x WHERE b > a""")
def lb_kassian(spark, d):
    return B.even_ranges(_sizes(spark, d), PROCS)


@query(f"""WITH {_SIZES}, o AS (SELECT *, sum(length * w) OVER (ORDER BY length * w, part_id) - length * w AS off, sum(length * w) OVER () / 16 AS opt FROM ps),
x AS (SELECT proc, part_id, start, w, greatest(ceil((proc * opt - off) / w - 1e-9), 0) AS a,
  CASE WHEN proc = 15 THEN length ELSE least(length, ceil(((proc + 1) * opt - off) / w - 1e-9)) END AS b FROM o CROSS JOIN procs)
SELECT proc, part_id, (start + a)::BIGINT AS start, (b - a)::BIGINT AS length, w AS per_site_weight FROM x WHERE b > a""")
def lb_benoit(spark, d):
    return B.weighted_ranges(_sizes(spark, d), PROCS)


@query("SELECT o_orderkey AS search_id, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 16)::INTEGER AS worker FROM orders")
def lb_coarse(spark, d):
    return B.round_robin(R.table(spark, d, "orders").select(F.col("o_orderkey").alias("search_id")), PROCS)


@query("SELECT p_partkey::INTEGER AS part_id, 0::INTEGER AS proc, 0::BIGINT AS start, (p_size * 100 + p_partkey % 97)::BIGINT AS length FROM part")
def lb_single_proc(spark, d):
    return B.equal_chunks(_sizes(spark, d), 1)


@query("SELECT p_partkey::INTEGER AS part_id, (p_size * 4)::DOUBLE AS per_site_weight FROM part")
def lb_weights(spark, d):
    p = R.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("part_id"), F.col("p_size").alias("states"), F.lit(4).alias("cats"))
    return B.site_weight(p).select("part_id", "per_site_weight")


@query(f"""WITH {_NAIVE}, p AS (SELECT proc, count(*) AS p, sum(length) AS s, sum(length * w) AS w FROM naive GROUP BY 1)
SELECT count(*)::BIGINT AS cores, min(p)::BIGINT AS min_parts, max(p)::BIGINT AS max_parts, min(s)::BIGINT AS min_sites, max(s)::BIGINT AS max_sites,
min(w) AS min_weight, max(w) AS max_weight, sum(p)::BIGINT AS total_parts, sum(s)::BIGINT AS total_sites, sum(w) AS total_weight FROM p""")
def assignment_stats(spark, d):
    s = _sizes(spark, d)
    a = B.equal_chunks(s, PROCS).join(s.select("part_id", "per_site_weight"), "part_id")
    return B.assignment_stats(a)


def _work(spark, d):
    e = R.table(spark, d, "events")
    return e.groupBy((F.col("user_id") % PROCS).cast("int").alias("proc")).agg(F.sum("value").alias("work_ms"))


@query(f"""WITH {_NAIVE}, wk AS (SELECT (user_id % 16)::INTEGER AS proc, sum(value) AS ms FROM events GROUP BY 1),
n AS (SELECT proc, sum(length) AS n FROM naive GROUP BY 1)
SELECT part_id, round(sum(ms / n * length), 6) AS work_ms FROM naive JOIN n USING (proc) JOIN wk USING (proc) GROUP BY 1""")
def work_by_partition(spark, d):
    return B.work_by_partition(B.equal_chunks(_sizes(spark, d), PROCS), _work(spark, d)).withColumn("work_ms", r6("work_ms"))


@query("SELECT max(ms) > 10000 AS rebalance FROM (SELECT sum(value) AS ms FROM events GROUP BY user_id % 16)")
def rebalance(spark, d):
    return B.needs_rebalance(_work(spark, d))


@query("SELECT part_id, w, row_number() OVER (ORDER BY w, part_id) - 1 AS rank FROM (SELECT p_partkey::INTEGER AS part_id, (p_size * 100 + p_partkey % 97)::BIGINT AS w FROM part)")
def sort_partitions_by_weight(spark, d):
    r = B._ranked(_sizes(spark, d))
    return r.select("part_id", F.col("length").alias("w"), F.col("_rank").alias("rank"))


# -- resources --------------------------------------------------------------------------

def _clv(spark, d):
    p = R.table(spark, d, "part")
    return p.select("p_partkey", (F.col("p_partkey") % 500 + 4).alias("taxa"), (F.col("p_size") * 1000).cast("bigint").alias("patterns"))


@query("""WITH x AS (SELECT p_partkey, (p_partkey % 500 + 4) AS taxa, p_size * 1000 AS patterns FROM part)
SELECT p_partkey, ((2 * taxa - 2) * (patterns * 16) * 8)::BIGINT AS mem, ((taxa - 2) * (patterns * 16) * 8 + taxa * patterns)::BIGINT AS mem_tip_inner FROM x""")
def resource_mem(spark, d):
    s, c = F.lit(4), F.lit(4)
    x = _clv(spark, d)
    return x.select("p_partkey", K.memory_bytes(F.col("taxa"), F.col("patterns"), s, c).alias("mem"),
                    K.memory_bytes(F.col("taxa"), F.col("patterns"), s, c, True).alias("mem_tip_inner"))


def _cores_sql(per: int) -> str:
    n = f"greatest(floor(clv / {per}.0 + 0.5), 1)"
    return (f"greatest(floor(clv / floor(CASE WHEN {n} <= 8 THEN {per}.0 / (4.0 - log2({n})) "
            f"ELSE {per}.0 * (log2({n}) - 2.0) END) + 0.5), 1)::BIGINT")


@query(f"""SELECT p_partkey, {_cores_sql(4000)} AS response, {_cores_sql(16000)} AS balanced, {_cores_sql(80000)} AS throughput
FROM (SELECT p_partkey, (p_size * 1000 * 16)::DOUBLE AS clv FROM part)""")
def resource_threads(spark, d):
    x = _clv(spark, d)
    clv = (F.col("patterns") * 16).cast("double")
    return x.select("p_partkey", *[K.cores_for(clv, g).alias(g) for g in ("response", "balanced", "throughput")])


@query(f"""SELECT p_partkey, CASE WHEN 32 > 2 * r THEN 'error' WHEN 32 > r THEN 'warning' ELSE 'ok' END AS verdict
FROM (SELECT p_partkey, {_cores_sql(4000)} AS r FROM (SELECT p_partkey, (p_size * 1000 * 16)::DOUBLE AS clv FROM part))""")
def check_threads(spark, d):
    x = _clv(spark, d)
    return x.select("p_partkey", K.thread_verdict(F.lit(32), K.cores_for((F.col("patterns") * 16).cast("double"), "response")).alias("verdict"))


# -- profiling --------------------------------------------------------------------------

TIMERS = R.EVENT_TAXA


def _timings(spark, d):
    e = R.table(spark, d, "events")
    return e.select((F.col("user_id") % 8).cast("int").alias("rank"), F.concat(F.lit("node"), (F.col("user_id") % 2).cast("string")).alias("processor"),
                    F.col("event_type").alias("timer"), "ts", F.col("value").alias("elapsed"), F.round(F.col("value") * 1000).cast("bigint").alias("ns"))


_T = """t AS (SELECT (user_id % 8)::INTEGER AS rank, 'node' || (user_id % 2) AS processor, event_type AS timer, ts, value AS elapsed, round(value * 1000)::BIGINT AS ns FROM events),
st AS (SELECT rank, processor, timer, count(*)::BIGINT AS num, sum(ns)::BIGINT AS ns_sum FROM t GROUP BY 1,2,3)"""
_BIN = """CASE WHEN abs(x - 1) < 0.001 THEN 100 WHEN x > 1 THEN (CASE WHEN x >= 10 THEN 200 ELSE floor((x - 1) * 10) + 101 END)
 WHEN x <= 0 OR 1.0 / x >= 10 THEN 99 ELSE floor((1.0 / x - 1) * 10) END::INTEGER"""
_NAME = """CASE WHEN b < 100 THEN format('{:.3f} to {:.3f}', 1 / (b / 10.0::DOUBLE + 1 + 0.1::DOUBLE), 1 / (b / 10.0::DOUBLE + 1)) WHEN b = 100 THEN '0.999 to 1.001'
 ELSE format('{:.3f} to {:.3f}', (b - 101) / 10.0::DOUBLE + 1, (b - 101) / 10.0::DOUBLE + 1 + 0.1::DOUBLE) END"""


@query(f"""WITH {_T}, m AS (SELECT timer, avg(elapsed) AS m FROM t GROUP BY 1), y AS (SELECT rank, processor, timer, {_BIN} AS b FROM (SELECT rank, processor, timer, elapsed / m AS x FROM t JOIN m USING (timer)))
SELECT rank, processor, timer, b AS bin_no, {_NAME} AS bin, count(*)::BIGINT AS count FROM y GROUP BY 1,2,3,4,5""")
def frac_histogram(spark, d):
    t = _timings(spark, d)
    m = t.groupBy("timer").agg(F.avg("elapsed").alias("mean"))
    return P.histogram(t.join(m, "timer"), ["rank", "processor", "timer"])


@query(f"""WITH y AS (SELECT l_orderkey, l_linenumber, {_BIN} AS b FROM (SELECT l_orderkey, l_linenumber, l_quantity / 25 AS x FROM lineitem))
SELECT b AS bin_no, {_NAME} AS bin, count(*)::BIGINT AS n FROM y GROUP BY 1,2""")
def bin_name(spark, d):
    b = R.table(spark, d, "lineitem").select(P.ratio_bin(F.col("l_quantity") / 25).alias("bin_no"))
    return b.groupBy("bin_no").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", P.bin_name(F.col("bin_no")))


@query(f"""WITH {_T} SELECT rank, processor, timer, num, ns_sum AS "nsSum" FROM st""")
def timer_stats(spark, d):
    return P.timer_stats(_timings(spark, d), ["rank", "processor", "timer"])


@query(f"""WITH {_T}, g AS (SELECT timer, count(*) AS c, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM t GROUP BY 1)
SELECT timer, floor(us / 1e6)::BIGINT AS "secondsPassed", round(c / (us / 1e6), 9) AS "callsPerSecond" FROM g""")
def calls_per_second(spark, d):
    return P.calls_per_second(_timings(spark, d)).withColumn("callsPerSecond", F.round("callsPerSecond", 9))


_WORK = "SELECT day(ts)::INTEGER AS time, (user_id % 8)::INTEGER AS rank, sum(value) AS work FROM events GROUP BY 1,2"


def _rank_work(spark, d):
    t = _timings(spark, d).withColumn("day", F.dayofmonth("ts"))
    return P.work_by_rank(t, "day", "rank", "elapsed")


@query(f'SELECT time, rank, round(work, 4) AS "workMs" FROM ({_WORK})')
def work_by_rank(spark, d):
    return _rank_work(spark, d).withColumn("workMs", F.round("workMs", 4))


@query(f"""WITH {_T} SELECT rank, processor, {', '.join(f"coalesce(sum(num) FILTER (timer='{t}'),0)::BIGINT AS num{t}, coalesce(sum(ns_sum) FILTER (timer='{t}'),0)::BIGINT AS nsSum{t}" for t in TIMERS)} FROM st GROUP BY 1,2""")
def overall_stats_pivot(spark, d):
    return P.overall_wide(P.timer_stats(_timings(spark, d), ["rank", "processor", "timer"]), TIMERS)


def _long(spark, d):
    return P.wide_to_long(overall_stats_pivot(spark, d), TIMERS)


_ACROSS = """ac AS (SELECT timer, avg(ns_sum / num) / 1e6 AS a, stddev_samp(ns_sum / num) / 1e6 AS b, avg(ns_sum) / 1e6 AS c, stddev_samp(ns_sum) / 1e6 AS e FROM st GROUP BY 1)"""


@query(f"""WITH {_T}, {_ACROSS}, rt AS (SELECT timer, sum(ns_sum)::DOUBLE / 1e6 AS runtime_ms FROM st GROUP BY 1)
SELECT timer, round(a,9) AS "msPerCallAvg", round(b,9) AS "msPerCallSD", round(c,6) AS "msTotalAvg", round(e,6) AS "msTotalSD", round(c / runtime_ms, 6) AS share FROM ac JOIN rt USING (timer)""")
def ft_long_format(spark, d):
    """Wide per-rank table to long, summarised over ranks and related to the timer's total."""
    long = _long(spark, d)
    rt = long.groupBy("timer").agg((F.sum("nsSum") / 1e6).alias("runtime_ms"))
    s = P.share_of_runtime(P.across_ranks(long), rt, "timer")
    return s.select("timer", F.round("msPerCallAvg", 9).alias("msPerCallAvg"), F.round("msPerCallSD", 9).alias("msPerCallSD"),
                    r6("msTotalAvg").alias("msTotalAvg"), r6("msTotalSD").alias("msTotalSD"), r6("share").alias("share"))


@query(f"""WITH w AS ({_WORK}) SELECT time, round(avg(work),6) AS "meanWorkMs", round(max(work),6) AS "maxWorkMs", round(max(work)/avg(work),6) AS "worseThanMeanRel", round(max(work)-avg(work),6) AS "worseThanMeanAbs" FROM w GROUP BY 1""")
def rebalance_eval(spark, d):
    r = P.rebalance_eval(_rank_work(spark, d))
    return r.select("time", F.round("meanWorkMs", 6).alias("meanWorkMs"), F.round("maxWorkMs", 6).alias("maxWorkMs"),
                    r6("worseThanMeanRel").alias("worseThanMeanRel"), F.round("worseThanMeanAbs", 6).alias("worseThanMeanAbs"))


@query("""WITH r AS (SELECT l_suppkey AS dataset, l_returnflag AS impl, sum(l_quantity) AS runtime FROM lineitem GROUP BY 1,2)
SELECT r.dataset, r.impl, r.runtime, round(r.runtime / b.runtime, 6) AS relative FROM r JOIN r b ON b.dataset = r.dataset AND b.impl = 'N'""")
def speedup(spark, d):
    r = R.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("dataset"), F.col("l_returnflag").alias("impl")).agg(F.sum("l_quantity").alias("runtime"))
    return P.speedup(r, "N").withColumn("relative", r6("relative"))


@query(f"""WITH g AS (SELECT user_id, count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS cps, sum(value) AS w FROM events GROUP BY 1)
SELECT round(corr(1.0 / cps, w), 6) AS correlation FROM g""")
def cps_correlation(spark, d):
    e = R.table(spark, d, "events").select("user_id", "ts", "value")
    c = P.calls_per_second(e, "user_id", "ts")
    w = e.groupBy("user_id").agg(F.sum("value").alias("weight"))
    return P.rate_correlation(c.join(w, "user_id")).select(r6("correlation").alias("correlation"))
