"""Registered queries over alignments, with their oracle statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.functions import states
from cladeframe.operators import bootstrap, checks, partitions, sites
from cladeframe.plans import recipes as R
from cladeframe.plans.catalog import sql as S

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


# -- aggregation ------------------------------------------------------------------------

@query(f"WITH {S.FOLDED_PATTERNS} SELECT part_id, pattern, weight, first_site FROM pats")
def compress_patterns(spark, d):
    return sites.compress_patterns(R.line_sites(spark, d), states.dna())


@query(f"WITH {S.EVENT_SITES} SELECT part_id, pattern, count(*)::BIGINT AS weight, min(site) AS first_site FROM event_sites GROUP BY 1,2")
def compress_patterns_binary(spark, d):
    return sites.compress_patterns(R.event_sites(spark, d), states.binary())


@query(f"WITH {S.VECTOR_SITES} SELECT part_id, pattern, count(*)::BIGINT AS weight, min(site) AS first_site FROM vector_sites GROUP BY 1,2")
def compress_patterns_wide(spark, d):
    return sites.compress_patterns(R.vector_sites(spark, d), states.dna())


@query(f"WITH {S.LINE_CELLS} SELECT part_id, site, taxon - 1 AS taxon_id, substr('{S.CODES}', mask + 1, 1) AS state FROM lcells")
def cells_from_sites(spark, d):
    return sites.cells_from_sites(R.line_sites(spark, d))


@query(f"WITH {S.VECTOR_SITES} SELECT part_id, site, pattern FROM vector_sites")
def sites_from_cells(spark, d):
    v = R.table(spark, d, "embeddings").select(
        F.col("label").alias("part_id"), F.col("vec_id").alias("site"), F.posexplode("embedding").alias("taxon_id", "x"))
    x = F.col("x").cast("double")
    cells = v.withColumn("state", F.when(x < -0.084, "A").when(x < 0, "C").when(x < 0.084, "G").otherwise("T"))
    return sites.sites_from_cells(cells, list(range(64)))


@query(f"""WITH {S.LINE_PATTERNS} SELECT part_id, sum(weight)::BIGINT AS sites, count(*)::BIGINT AS patterns
FROM pats GROUP BY ROLLUP (part_id)""")
def total_length(spark, d):
    return sites.totals(sites.compress_patterns(R.line_sites(spark, d)))


@query(f"WITH {S.LINE_PATTERNS} SELECT sum(weight)::BIGINT AS num_sites FROM pats")
def num_sites(spark, d):
    return sites.compress_patterns(R.line_sites(spark, d)).agg(F.sum("weight").alias("num_sites"))


_STATS = f"""WITH {S.LINE_CELLS},
percol AS (SELECT part_id, site, bit_and(CASE WHEN mask=0 THEN 15 ELSE mask END) <> 0 AS inv,
  count(*) FILTER (mask IN (0,15)) AS gaps, string_agg(substr('{S.CODES}', mask % 15 + 1, 1), '' ORDER BY taxon) AS pattern
  FROM lcells GROUP BY 1,2)"""


@query(f"""{_STATS} SELECT part_id, count(*)::BIGINT AS site_count, count(DISTINCT pattern)::BIGINT AS pattern_count,
round(sum(gaps)/(7.0*count(*)),6) AS gap_prop, round(count(*) FILTER (inv)/count(*)::DOUBLE,6) AS inv_prop,
count(*) FILTER (inv)::BIGINT AS inv_count FROM percol GROUP BY 1""")
def part_stats(spark, d):
    st = sites.part_stats(sites.compress_patterns(R.line_sites(spark, d), states.dna()))
    return st.select("part_id", "site_count", "pattern_count", r6("gap_prop").alias("gap_prop"),
                     r6("inv_prop").alias("inv_prop"), "inv_count")


@query(f"""WITH {S.VECTOR_CELLS} SELECT part_id, count(DISTINCT site)::BIGINT AS site_count, 0.0::DOUBLE AS gap_prop,
round(count(DISTINCT site) FILTER (inv)/count(DISTINCT site)::DOUBLE,6) AS inv_prop
FROM (SELECT part_id, site, min(state)=max(state) AS inv FROM vcells GROUP BY 1,2) GROUP BY 1""")
def inv_prop(spark, d):
    st = sites.part_stats(sites.compress_patterns(R.vector_sites(spark, d), states.dna()))
    return st.select("part_id", "site_count", r6("gap_prop").alias("gap_prop"), r6("inv_prop").alias("inv_prop"))


@query(f"""WITH {S.LINE_CELLS}, m AS (SELECT part_id, CASE WHEN mask=0 THEN 15 ELSE mask END AS mask FROM lcells),
f AS (SELECT part_id, s.i, sum(CASE WHEN (mask >> s.i) & 1 = 1 THEN 1.0::DOUBLE/bit_count(mask) ELSE 0 END) AS x
  FROM m CROSS JOIN (SELECT unnest(range(0,4)) AS i) s GROUP BY 1,2)
SELECT part_id, substr('ACGT', (i+1)::INTEGER, 1) AS state, round(x/sum(x) OVER (PARTITION BY part_id),6) AS freq FROM f""")
def emp_base_freqs(spark, d):
    f = sites.empirical_freqs(sites.compress_patterns(R.line_sites(spark, d), states.dna()))
    return f.select("part_id", "state", r6("freq").alias("freq"))


@query(f"""WITH {S.VECTOR_CELLS}, c AS (SELECT part_id, site, state, count(*) AS k FROM vcells GROUP BY 1,2,3),
p AS (SELECT a.part_id, a.state || b.state AS pair, sum(a.k*b.k)::BIGINT AS n FROM c a JOIN c b ON a.site=b.site AND a.state<b.state GROUP BY 1,2)
SELECT part_id, pair, n, round(n::DOUBLE/(sum(n) FILTER (pair='GT') OVER (PARTITION BY part_id)),6) AS rate FROM p""")
def emp_subst_rates(spark, d):
    r = sites.empirical_rates(sites.compress_patterns(R.vector_sites(spark, d), states.dna()))
    return r.select("part_id", "pair", "n", r6("rate").alias("rate"))


@query(f"""WITH {S.LINE_PATTERNS} SELECT CASE WHEN part_id=2 THEN 'B' ELSE 'A' END AS datatype, pattern,
sum(weight)::BIGINT AS weight, min(first_site) AS first_site FROM pats GROUP BY 1,2""")
def merge_by_datatype(spark, d):
    p = sites.compress_patterns(R.line_sites(spark, d))
    return sites.merge_by_datatype(p, {0: "A", 1: "A", 2: "B"})


@query(f"""WITH {S.LINE_PATTERNS}, l AS (SELECT part_id, sum(weight)::BIGINT AS length FROM pats GROUP BY 1)
SELECT part_id, round(length::DOUBLE/sum(length) OVER (),6) AS share FROM l""")
def part_contribution(spark, d):
    n = sites.compress_patterns(R.line_sites(spark, d)).groupBy("part_id").agg(F.sum("weight").alias("length"))
    return partitions.contribution(n).select("part_id", r6("share").alias("share"))


_PROBS = "SELECT vec_id, list_transform(embedding::DOUBLE[][:4], lambda x: abs(x)) AS p FROM embeddings"


def _prob_cells(spark, d):
    """Four probability-like numbers per cell: 16 cells of each vector's 64 absolute values."""
    v = R.table(spark, d, "embeddings")
    q = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(
        F.slice("embedding", i * 4 + 1, F.lit(4)), lambda x: F.abs(x.cast("double"))))
    return v.select("vec_id", F.posexplode(q).alias("taxon_id", "probs"))


@query("""WITH c AS (SELECT (i - 1) % 4 AS state_no, abs(x) AS p FROM
(SELECT unnest(range(1,65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings))
SELECT state_no::INTEGER AS state_no, round(avg(p),6) AS freq FROM c GROUP BY 1""")
def prob_freqs(spark, d):
    return sites.probability_freqs(_prob_cells(spark, d)).select("state_no", r6("freq").alias("freq"))


@query("SELECT max(abs(x)) <= 1.0 AS normalised FROM (SELECT unnest(embedding::DOUBLE[]) AS x FROM embeddings)")
def prob_normalised(spark, d):
    return sites.probabilities_normalised(_prob_cells(spark, d))


@query("""WITH c AS (SELECT vec_id, (i - 1) // 4 AS taxon_id, (i - 1) % 4 AS k, abs(x) * 20 AS p FROM
(SELECT vec_id, unnest(range(1,65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings)),
n AS (SELECT vec_id, taxon_id, max(p) AS m, sum(p) AS s FROM c GROUP BY 1,2)
SELECT k::INTEGER AS state_no, round(sum(CASE WHEN m > 1 THEN p / s WHEN m <= 0 THEN 1 ELSE p END), 4) AS total
FROM c JOIN n USING (vec_id, taxon_id) GROUP BY 1""")
def tip_clv(spark, d):
    c = _prob_cells(spark, d).withColumn("probs", F.transform("probs", lambda x: x * 20))
    t = c.select(F.posexplode(sites.tip_vector(F.col("probs"))).alias("state_no", "p"))
    return t.groupBy("state_no").agg(F.round(F.sum("p"), 4).alias("total"))


# -- checks -----------------------------------------------------------------------------

@query("""SELECT p_partkey AS taxon_id, first_id FROM part
JOIN (SELECT p_name, min(p_partkey) AS first_id FROM part GROUP BY 1) USING (p_name) WHERE p_partkey > first_id""")
def check_dup_names(spark, d):
    taxa = R.table(spark, d, "part").select(F.col("p_partkey").alias("taxon_id"), F.col("p_name").alias("label"))
    return checks.duplicate_names(taxa)


@query("""SELECT p_partkey AS taxon_id, p_name AS label, translate(p_name, '(),;:'' ', '_______') AS fixed_label
FROM part WHERE translate(p_name, '(),;:'' ', '_______') <> p_name""")
def check_invalid_names(spark, d):
    taxa = R.table(spark, d, "part").select(F.col("p_partkey").alias("taxon_id"), F.col("p_name").alias("label"))
    return checks.invalid_names(taxa)


@query("SELECT count(*)::BIGINT AS n_taxa FROM region HAVING count(*) < 4")
def check_min_taxa(spark, d):
    return checks.too_few_taxa(R.table(spark, d, "region"))


@query("""SELECT lang AS aln_id, min(length(text)) AS min_length, max(length(text)) AS max_length
FROM documents GROUP BY 1 HAVING min(length(text)) <> max(length(text))""")
def check_equal_lengths(spark, d):
    s = R.table(spark, d, "documents").select(F.col("lang").alias("aln_id"), F.col("text").alias("sequence"))
    r = checks.unequal_lengths(s)
    return r.select("aln_id", F.col("min_length").cast("bigint").alias("min_length"),
                    F.col("max_length").cast("bigint").alias("max_length"))


_AA = "".join(sorted(set(states.protein().symbols()))).replace("'", "''")


@query(f"""WITH ch AS (SELECT doc_id AS taxon_id, unnest(range(1, length(text)+1)) AS position, text FROM documents),
x AS (SELECT taxon_id, position, substr(text, position, 1) AS symbol FROM ch)
SELECT taxon_id, symbol, count(*)::BIGINT AS n, min(position)::BIGINT AS first_position FROM x
WHERE strpos('{_AA}', symbol) = 0 GROUP BY 1,2""")
def check_invalid_chars(spark, d):
    return checks.invalid_character_counts(R.document_sequences(spark, d), states.protein())


@query("""SELECT doc_id AS taxon_id, first_id FROM documents
JOIN (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY 1) USING (text) WHERE doc_id > first_id""")
def dup_seqs(spark, d):
    return checks.duplicate_sequences(R.document_sequences(spark, d))


@query(f"WITH {S.ORDER_SITES} SELECT part_id, site FROM order_sites WHERE translate(pattern, '-N', '') = ''")
def gap_cols(spark, d):
    return sites.gap_columns(R.order_sites(spark, d)).select("part_id", "site")


@query(f"""WITH {S.ORDER_SITES} SELECT part_id, pattern, count(*)::BIGINT AS weight, min(site) AS first_site
FROM order_sites WHERE translate(pattern, '-N', '') <> '' GROUP BY 1,2""")
def drop_gap_cols(spark, d):
    return sites.compress_patterns(sites.drop_gap_columns(R.order_sites(spark, d)))


@query("""SELECT c_custkey AS taxon_id FROM customer WHERE c_custkey NOT IN
(SELECT o_custkey FROM orders WHERE o_orderstatus='P')""")
def gap_seqs(spark, d):
    taxa = R.table(spark, d, "customer").select(F.col("c_custkey").alias("taxon_id"))
    return checks.gap_only_taxa(R.customer_presence(spark, d), taxa)


@query("""WITH pr AS (SELECT DISTINCT o_orderpriority AS p FROM orders)
SELECT c_custkey AS taxon_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P' AND o_orderpriority IN (SELECT p FROM pr WHERE p < '3'))
INTERSECT SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P' AND o_orderpriority >= '3')""")
def gap_seq_intersect(spark, d):
    taxa = R.table(spark, d, "customer").select(F.col("c_custkey").alias("taxon_id"))
    have = R.customer_presence(spark, d)
    first = checks.gap_only_taxa(have.where("part_id < '3'"), taxa)
    return first.intersect(checks.gap_only_taxa(have.where("part_id >= '3'"), taxa))


_PRIO = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("""WITH pr AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) AS k FROM (SELECT DISTINCT o_orderpriority FROM orders)),
h AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders WHERE o_orderstatus='P')
SELECT c_custkey AS taxon_id, string_agg(CASE WHEN h.o_custkey IS NULL THEN '0' ELSE '1' END, '' ORDER BY pr.k) AS presence
FROM customer CROSS JOIN pr LEFT JOIN h ON h.o_custkey=c_custkey AND h.p=pr.p GROUP BY 1""")
def terrace_presence(spark, d):
    taxa = R.table(spark, d, "customer").select(F.col("c_custkey").alias("taxon_id"))
    parts = R.table(spark, d, "orders").select(F.col("o_orderpriority").alias("part_id")).distinct()
    return checks.presence_matrix(R.customer_presence(spark, d), taxa, parts)


_REDUCED = f"""WITH {S.ORDER_SITES},
ok AS (SELECT * FROM order_sites WHERE translate(pattern, '-N', '') <> ''),
cc AS (SELECT part_id, site, taxon, substr(pattern, taxon::INTEGER, 1) AS c FROM ok CROSS JOIN (SELECT unnest(range(1,8)) AS taxon))"""


@query(f"""{_REDUCED} SELECT part_id, taxon - 1 AS taxon, 'L' || taxon AS label, site // 1000 AS chunk,
string_agg(c, '' ORDER BY site) AS segment FROM cc GROUP BY 1,2,3,4""")
def reduced_msa(spark, d):
    full = R.order_sites(spark, d)
    view = partitions.AlignmentView(full, R.LINE_TAXA).exclude_sites(sites.gap_columns(full))
    v = view.sequence_chunks(1000)
    return v.select("part_id", F.col("taxon").cast("bigint").alias("taxon"), "label", "chunk", "segment")


_LINE_W = "SELECT l_orderkey AS site, count(*)::BIGINT AS w FROM lineitem GROUP BY 1"


def _line_weights(spark, d):
    li = R.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("site")).agg(F.count(F.lit(1)).alias("weight")).withColumn(
        "part_id", (F.col("site") % 3).cast("int"))


@query(f"""WITH {S.ORDER_SITES}, w AS ({_LINE_W})
SELECT part_id, sum(coalesce(w, 1))::BIGINT AS sites FROM order_sites LEFT JOIN w USING (site) GROUP BY 1""")
def view_site_weights(spark, d):
    v = partitions.AlignmentView(R.order_sites(spark, d), R.LINE_TAXA).weights(_line_weights(spark, d))
    return v.total_sites()


@query(f"""WITH {S.ORDER_SITES}, w AS ({_LINE_W})
SELECT part_id, sum(w)::BIGINT AS sites FROM order_sites JOIN w USING (site)
WHERE translate(pattern, '-N', '') <> '' GROUP BY 1""")
def view_exclude_sites(spark, d):
    full = R.order_sites(spark, d)
    v = partitions.AlignmentView(full, R.LINE_TAXA).weights(_line_weights(spark, d)).exclude_sites(
        sites.gap_columns(full))
    return v.total_sites()


@query(f"""WITH {S.LINE_SITES} SELECT part_id, substr(pattern,1,2) || substr(pattern,4,4) AS pattern,
count(*)::BIGINT AS weight, min(site) AS first_site FROM line_sites GROUP BY 1,2""")
def view_exclude_taxon(spark, d):
    v = partitions.AlignmentView(R.line_sites(spark, d), R.LINE_TAXA).exclude_taxa([2])
    return sites.compress_patterns(v.to_sites(), weight="weight")


@query(f"""WITH {S.LINE_SITES}, w AS ({_LINE_W}),
cc AS (SELECT part_id, site, w, taxon, substr(pattern, taxon::INTEGER, 1) AS c FROM line_sites JOIN w USING (site)
  CROSS JOIN (SELECT unnest(range(1,8)) AS taxon))
SELECT part_id, taxon - 1 AS taxon, CASE WHEN taxon=2 THEN 'Mouse' ELSE 'L' || taxon END AS label, site // 1000 AS chunk,
string_agg(repeat(c, w), '' ORDER BY site) AS segment FROM cc GROUP BY 1,2,3,4""")
def view_uncompress(spark, d):
    v = partitions.AlignmentView(R.line_sites(spark, d), R.LINE_TAXA).rename({"L2": "Mouse"}).weights(
        _line_weights(spark, d))
    return v.sequence_chunks(1000).select("part_id", F.col("taxon").cast("bigint").alias("taxon"), "label", "chunk", "segment")


@query("""SELECT c_custkey AS taxon_id, CASE WHEN k > 1 THEN n_name || '_' || c_custkey ELSE n_name END AS label
FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) USING (c_nationkey)""")
def view_rename_taxon(spark, d):
    c = R.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    k = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    n = R.table(spark, d, "nation").join(k, F.col("n_nationkey") == F.col("c_nationkey")).select("c_nationkey", "n_name", "k")
    return c.join(n, "c_nationkey").select(F.col("c_custkey").alias("taxon_id"), F.when(
        F.col("k") > 1, F.concat_ws("_", "n_name", F.col("c_custkey").cast("string"))).otherwise(F.col("n_name")).alias("label"))


# -- partition schemes ------------------------------------------------------------------

def _part_ranges(spark, d):
    """One range string per part: a single column, a run or a strided run around its key."""
    p = R.table(spark, d, "part")
    a = F.col("p_partkey") + 1
    b = a + F.col("p_size")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, a.cast("string")).when(k == 1, F.concat_ws("-", a, b)).when(
        k == 2, F.concat(a, F.lit("-"), b, F.lit("\\2"))).otherwise(F.concat(a, F.lit(" - "), b, F.lit("/3,"), b + 7))
    return p.select(F.col("p_partkey").cast("int").alias("part_id"), text.alias("range_string"))


_RANGES = """rr AS (SELECT p_partkey::INTEGER AS part_id, p_partkey + 1 AS start,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1 ELSE p_partkey + 1 + p_size END AS stop,
  CASE p_partkey % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END::BIGINT AS stride FROM part
  UNION ALL SELECT p_partkey::INTEGER, p_partkey + 1 + p_size + 7, p_partkey + 1 + p_size + 7, 1 FROM part WHERE p_partkey % 4 = 3)"""


@query(f"WITH {_RANGES} SELECT part_id, start, stop, stride FROM rr")
def parse_ranges(spark, d):
    return partitions.parse_ranges(_part_ranges(spark, d))


@query(f"""WITH {_RANGES}, s AS (SELECT unnest(range(start, stop + 1, stride)) AS site FROM rr),
c AS (SELECT site, count(*) AS n FROM s GROUP BY 1)
SELECT p_partkey + 1 AS site, coalesce(n, 0)::BIGINT AS n FROM part LEFT JOIN c ON site = p_partkey + 1 WHERE coalesce(n, 0) <> 1""")
def site_partition_map(spark, d):
    universe = R.table(spark, d, "part").select((F.col("p_partkey") + 1).alias("site"))
    return partitions.cover_counts(partitions.parse_ranges(_part_ranges(spark, d)), universe)


@query(f"""WITH {S.LINE_SITES}, m AS (SELECT CASE WHEN site <= 4999 THEN (CASE WHEN site % 2 = 1 THEN 1 ELSE 2 END) ELSE 3 END AS part_id, pattern FROM line_sites)
SELECT part_id, pattern, count(*)::BIGINT AS weight FROM m GROUP BY 1,2""")
def split_msa(spark, d):
    scheme = [(1, 1, 4999, 2), (2, 0, 4999, 2), (3, 5000, 1 << 60, 1)]
    routed = partitions.split_by_ranges(R.line_sites(spark, d).drop("part_id"), scheme)
    return sites.compress_patterns(routed).drop("first_site")


@query(f"""WITH {S.LINE_SITES} SELECT part_id, site, row_number() OVER (PARTITION BY part_id ORDER BY site) - 1 AS local_site,
row_number() OVER (ORDER BY site) - 1 AS global_site FROM line_sites""")
def global_site(spark, d):
    local = partitions.local_sites(R.line_sites(spark, d).select("part_id", "site"))
    return sites.dense_offsets(local, "site", name="global_site")


@query(f"""WITH {S.LINE_PATTERNS} SELECT part_id, pattern, weight,
coalesce(sum(weight) OVER (PARTITION BY part_id ORDER BY first_site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS start_site FROM pats""")
def bootstrap_offsets(spark, d):
    p = sites.compress_patterns(R.line_sites(spark, d))
    return sites.dense_offsets(p, "first_site", F.col("weight"), by=("part_id",), name="start_site").drop("first_site")


@query(f"""WITH {S.LINE_PATTERNS}, l AS (SELECT part_id, sum(weight)::BIGINT AS length FROM pats GROUP BY 1)
SELECT part_id, (sum(length) OVER (ORDER BY part_id) - length + 1)::BIGINT AS start, (sum(length) OVER (ORDER BY part_id))::BIGINT AS stop FROM l""")
def partition_offsets(spark, d):
    n = sites.compress_patterns(R.line_sites(spark, d)).groupBy("part_id").agg(F.sum("weight").alias("length"))
    return partitions.partition_offsets(n)


@query("""WITH c AS (SELECT c_custkey AS taxon_id, c_name AS label, EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P' AND o_orderpriority='1-URGENT') AS constrained FROM customer)
SELECT taxon_id, label, constrained, row_number() OVER (ORDER BY constrained DESC, taxon_id) - 1 AS tip_index FROM c""")
def constraint_tip_order(spark, d):
    c = R.table(spark, d, "customer").select(F.col("c_custkey").alias("taxon_id"), F.col("c_name").alias("label"))
    o = R.table(spark, d, "orders").where("o_orderstatus='P' AND o_orderpriority='1-URGENT'").select(
        F.col("o_custkey").alias("taxon_id"))
    return checks.constraint_tip_order(c, c.join(o, "taxon_id", "left_semi"))


# -- resampling -------------------------------------------------------------------------

REPS = 10
_S1 = "((i % 2147483647) * 48271 + (r * 1000 + part_id)::BIGINT * 69621 + 1) % 2147483647"
_HI = S.mix(_S1)
_DRAWS = f"""dense AS (SELECT part_id, site, pattern, row_number() OVER (PARTITION BY part_id ORDER BY site) - 1 AS i,
  count(*) OVER (PARTITION BY part_id) AS n FROM line_sites),
h AS (SELECT r, part_id, i, n, {_HI} AS hi FROM dense CROSS JOIN (SELECT unnest(range(0,{REPS})) AS r)),
h2 AS (SELECT r, part_id, n, hi, (hi + i % 2147483647) % 2147483647 AS s FROM h),
u AS (SELECT r, part_id, (hi * 2147483648 + {S.mix('s')}) % n AS u FROM h2),
bw AS (SELECT u.r::INTEGER AS replicate, u.part_id, d.pattern, count(*)::BIGINT AS weight
  FROM u JOIN dense d ON d.part_id = u.part_id AND d.i = u.u GROUP BY 1,2,3)"""


@query(f"WITH {S.LINE_SITES}, {_DRAWS} SELECT replicate, part_id, pattern, weight FROM bw")
def bootstrap_weights(spark, d):
    return bootstrap.draw_weights(R.line_sites(spark, d), REPS)


@query(f"""WITH {S.LINE_SITES}, {_DRAWS} SELECT replicate, part_id, sum(weight)::BIGINT AS sites,
count(*)::BIGINT AS patterns, max(weight)::BIGINT AS heaviest FROM bw GROUP BY 1,2""")
def bootstrap_multi(spark, d):
    w = bootstrap.draw_weights(R.line_sites(spark, d), REPS)
    return w.groupBy("replicate", "part_id").agg(F.sum("weight").alias("sites"), F.count(F.lit(1)).alias("patterns"),
                                                 F.max("weight").alias("heaviest"))


@query(f"""WITH {S.LINE_PATTERNS}, {_DRAWS}, a AS (SELECT r.replicate, p.part_id, p.pattern, coalesce(bw.weight,0) AS w
  FROM pats p CROSS JOIN (SELECT unnest(range(0,{REPS}))::INTEGER AS replicate) r LEFT JOIN bw USING (replicate, part_id, pattern))
SELECT replicate, count(*) FILTER (w > 0)::BIGINT AS kept, count(*) FILTER (w = 0)::BIGINT AS dropped FROM a GROUP BY 1""")
def bs_drop_zero(spark, d):
    s = R.line_sites(spark, d)
    w = bootstrap.draw_weights(s, REPS)
    total = sites.compress_patterns(s).agg(F.count(F.lit(1))).scalar()
    kept = w.where("weight > 0").groupBy("replicate").agg(F.count(F.lit(1)).alias("kept"))
    return kept.withColumn("_n", total).select("replicate", "kept", (F.col("_n") - F.col("kept")).alias("dropped"))


@query(f"""WITH {S.LINE_SITES}, {_DRAWS},
f AS (SELECT part_id, pattern, min(site) AS first_site FROM line_sites GROUP BY 1,2),
c AS (SELECT replicate, b.part_id, t.taxon, string_agg(repeat(substr(b.pattern, t.taxon::INTEGER, 1), b.weight), '' ORDER BY f.first_site) AS s
  FROM bw b JOIN f USING (part_id, pattern) CROSS JOIN (SELECT unnest(range(1,8)) AS taxon) t GROUP BY 1,2,3),
k AS (SELECT *, unnest(range(0, (length(s) + 999) // 1000)) AS chunk FROM c)
SELECT replicate, part_id, chunk, taxon - 1 AS taxon, substr(s, chunk * 1000 + 1, 1000) AS segment FROM k""")
def bootstrap_msa(spark, d):
    s = R.line_sites(spark, d)
    return bootstrap.replicate_chunks(bootstrap.draw_weights(s, REPS), sites.compress_patterns(s), len(R.LINES), 1000)


@query(f"""WITH {S.LINE_PATTERNS} SELECT part_id, sum(weight)::BIGINT AS sites, {REPS}::BIGINT AS replicates,
true AS sums_match FROM pats GROUP BY 1""")
def bootstrap_multinomial(spark, d):
    p = sites.compress_patterns(R.line_sites(spark, d))
    w = bootstrap.multinomial_weights(p, REPS, seed=7)
    per = w.groupBy("part_id", "replicate").agg(F.sum("weight").alias("s"))
    n = p.groupBy("part_id").agg(F.sum("weight").alias("sites"))
    return per.join(n, "part_id").groupBy("part_id", "sites").agg(
        F.count(F.lit(1)).alias("replicates"), F.min(F.col("s") == F.col("sites")).alias("sums_match"))
