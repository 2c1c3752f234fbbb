"""Registered queries that go through a file format: write derived data, read it back.

Files live in a fresh folder under the session's shared directory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cladeframe.operators import bootstrap, likelihood as L, sites, terraces, treesets as TS
from cladeframe.operators.partitions import AlignmentView
from cladeframe.plans import recipes as R
from cladeframe.plans.catalog import likelihoods as LK, sql as S, trees as TQ
from cladeframe.session import shared_dir
from cladeframe.sources import alignments as A, schemes, sinks, store
from cladeframe.sources.trees import read_trees

Q: dict = {}
O: dict = {}


def query(oracle: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if oracle:
            O[fn.__name__] = oracle
        return fn
    return add


def folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


_EV = f"WITH {S.EVENT_SITES} SELECT row_number() OVER (ORDER BY site) - 1 AS site, pattern FROM event_sites"


@query(_EV)
def sink_phylip(spark, d):
    """Event alignment written as interleaved PHYLIP and read again."""
    path = folder(spark)
    sinks.write_phylip(AlignmentView(R.event_sites(spark, d), R.EVENT_TAXA).sequence_chunks(1000), path)
    return A.read_alignment(spark, path, "iphylip").sites.select("site", "pattern")


@query(_EV)
def scan_auto(spark, d):
    path = folder(spark)
    sinks.write_phylip(AlignmentView(R.event_sites(spark, d), R.EVENT_TAXA).sequence_chunks(5000000), path)
    return A.read_alignment(spark, path).sites.select("site", "pattern")


def _vector_rows(spark, d):
    """Vectors as sequences: one record per vector, one symbol per dimension."""
    v = R.vector_sites(spark, d)
    return v.select(F.concat(F.lit("v"), F.col("site").cast("string")).alias("label"), F.col("pattern").alias("sequence"), F.col("site").alias("id"))


_VROW = f"""WITH {S.VECTOR_CELLS} SELECT taxon_id::BIGINT AS site, string_agg(state, '' ORDER BY site) AS pattern FROM vcells GROUP BY 1"""


@query(_VROW)
def scan_fasta(spark, d):
    path = folder(spark)
    rows = _vector_rows(spark, d)
    rows.repartitionByRange("id").sortWithinPartitions("id").select(
        F.concat(F.lit(">"), "label", F.lit("\n"), F.substring("sequence", 1, 40), F.lit("\n"), F.substring("sequence", 41, 24)).alias("value")).write.text(path)
    return A.read_fasta(spark, path).sites.select("site", "pattern")


@query(_VROW)
def scan_phylip(spark, d):
    path = folder(spark)
    rows = _vector_rows(spark, d)
    head = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).cast("bigint").alias("id"), F.concat(F.col("n").cast("string"), F.lit(" 64")).alias("value"))
    body = rows.select("id", F.concat_ws(" ", "label", "sequence").alias("value"))
    head.unionByName(body).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)
    return A.read_phylip(spark, path).sites.select("site", "pattern")


@query("""WITH c AS (SELECT vec_id, unnest(range(1,65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
p AS (SELECT row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS site, (i - 1) // 4 AS taxon_id, CASE (i - 1) % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 2 END AS k, abs(x) AS p FROM c)
SELECT site, taxon_id::INTEGER AS taxon_id, k::INTEGER AS state_no, round(p, 6) AS p FROM p""")
def scan_catg(spark, d):
    """Absolute values in groups of four as C, A, T, G probabilities of 16 taxa."""
    path = folder(spark)
    v = R.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.format_string("%.12f", F.abs(x.cast("double")))).alias("e"))
    lists = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array_join(F.slice("e", i * 4 + 1, F.lit(4)), ","))
    body = v.select(F.col("vec_id").alias("id"), F.concat(F.lit("A" * 16 + " "), F.array_join(lists, " ")).alias("value"))
    n = v.agg(F.count(F.lit(1)).alias("n"))
    head = n.select(F.lit(-2).cast("bigint").alias("id"), F.concat(F.lit("16 "), F.col("n").cast("string")).alias("value"))
    names = n.select(F.lit(-1).cast("bigint").alias("id"), F.lit(" ".join(f"s{i}" for i in range(16))).alias("value"))
    head.unionByName(names).unionByName(body).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)
    p = A.read_catg(spark, path).probs
    return p.select("site", "taxon_id", F.posexplode("probs").alias("state_no", "p")).withColumn("p", F.round("p", 6))


@query(f"WITH {S.LINE_PATTERNS} SELECT part_id, pattern, weight, first_site FROM pats WHERE part_id <> 0")
def scan_rba(spark, d):
    """Compressed alignment stored, two of its partitions loaded."""
    path = folder(spark)
    s = R.line_sites(spark, d)
    store.write_store(A.Alignment(s, R.LINE_TAXA), sites.compress_patterns(s), path)
    return store.read_store(spark, path, [1, 2]).patterns


@query(f"WITH {TQ.SUP}, ids AS (SELECT tree_id, row_number() OVER (ORDER BY tree_id) - 1 AS no FROM (SELECT DISTINCT tree_id FROM counts)) SELECT no AS tree_id, split FROM splits JOIN ids USING (tree_id)")
def scan_newick(spark, d):
    path = folder(spark)
    sinks.write_trees(TQ.supplier_trees(spark, d), path)
    return TQ.splits(read_trees(spark, path), TQ.LINES)


@query(f"""WITH {TQ.MON} SELECT tree_id - 1 AS tree_id, split FROM splits UNION ALL SELECT tree_id + 11, split FROM splits""")
def scan_newick_multi(spark, d):
    a, b = folder(spark), folder(spark)
    t = TQ.month_trees(spark, d)
    sinks.write_trees(t, a)
    sinks.write_trees(t, b)
    return TQ.splits(read_trees(spark, f"{a},{b}"), TQ.NATIONS)


@query(f"""WITH {TQ.MON}, {TQ._RF} SELECT (tree_i - 1)::INTEGER AS i, (tree_j - 1)::INTEGER AS j, rf::INTEGER AS rf, printf('%.6f', rf / 44.0) AS rrf FROM rf""")
def sink_rf_tsv(spark, d):
    path = folder(spark)
    t = TQ.month_trees(spark, d)
    sinks.write_rf(TS.rf_pairwise(TQ.splits(t, TQ.NATIONS), t, 25), t, path)
    return spark.read.option("sep", "\t").schema("i INT, j INT, rf INT, rrf STRING").csv(path)


@query("""WITH s AS (SELECT p_brand, sum(p_size)::BIGINT AS n, row_number() OVER (ORDER BY p_brand) AS k FROM part GROUP BY 1),
o AS (SELECT p_brand, k, n, sum(n) OVER (ORDER BY p_brand)::BIGINT AS stop FROM s)
SELECT (k - 1)::INTEGER AS part_id, p_brand AS name, stop - n + 1 AS start, stop FROM o""")
def scan_partition_file(spark, d):
    """Scheme text with contiguous ranges written from brand sizes, stored and parsed."""
    rows = R.table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("n")).orderBy("p_brand").collect()
    parts = [schemes.Part(i, r["p_brand"], "GTR+G", "1") for i, r in enumerate(rows)]
    text = schemes.write_scheme(parts, lengths={i: r["n"] for i, r in enumerate(rows)})
    path = folder(spark)
    spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.text(path)
    got = schemes.read_scheme(spark, path)
    names = {p.part_id: p.name for p in got}
    return spark.createDataFrame([(p, names[p], a, b) for p, a, b, _ in schemes.scheme_ranges(spark, got)], "part_id INT, name STRING, start BIGINT, stop BIGINT")


@query(f"""WITH {S.EVENT_SITES}, l AS (SELECT unnest(range(0,3)) AS r) SELECT r::INTEGER AS replicate, (SELECT count(*) FROM event_sites)::BIGINT AS sites FROM l""")
def sink_bootstrap_msa(spark, d):
    path = folder(spark)
    p = sites.compress_patterns(R.event_sites(spark, d))
    w = bootstrap.multinomial_weights(p, 3)
    sinks.write_replicates(bootstrap.replicate_chunks(w, p, 5), R.EVENT_TAXA, path)
    out = None
    for r in range(3):
        n = A.read_phylip(spark, f"{path}/replicate={r}", True).sites.agg(F.count(F.lit(1)).alias("sites")).select(F.lit(r).alias("replicate"), "sites")
        out = n if out is None else out.unionByName(n)
    return out


@query(LK._ANC + ", loc AS (SELECT part_id, site, pattern, row_number() OVER (PARTITION BY part_id ORDER BY site) AS k FROM line_sites) "
       "SELECT 'Node' || (node + 1) AS \"Node\", (part_id + 1)::VARCHAR AS \"Part\", k::VARCHAR AS \"Site\", printf('%.4f', round(p[1], 4)) AS \"p_A\" FROM pr JOIN loc USING (part_id, pattern)")
def sink_ancestral_probs(spark, d):
    path = folder(spark)
    from cladeframe.functions.models import parse_model
    a = parse_model("JC").alphabet
    st = L.ancestral_states(LK._ancestral(spark, d), a).join(R.line_sites(spark, d), ["part_id", "pattern"])
    sinks.write_ancestral_probs(st, a.states, path, 3, precision=17)  # fewer digits would be rounded twice
    r = spark.read.option("sep", "\t").option("header", True).csv(path)
    return r.select("Node", "Part", "Site", F.format_string("%.4f", F.round(F.col("p_A").cast("double"), 4)).alias("p_A"))


def _all_topologies(n: int) -> list[list[int]]:
    """Splits of all unrooted binary trees over n taxa as bit masks of the side without the first taxon."""
    grown = [[0b110, 0b010, 0b100]]  # three tips: the branches above them, by what is below
    for k in range(3, n):
        new = 1 << k
        grown = [[m | new if m & e == e and m != e else m for m in t] + [e | new, new] for t in grown for e in t]
    return [sorted(m for m in t if m.bit_count() > 1 and m.bit_count() < n - 1) for t in grown]


def _terrace_sql() -> str:
    """Trees with the same splits as the supplier's in every flag's taxa, among all topologies of seven."""
    every = ", ".join(f"({i}, {t})" for i, t in enumerate(_all_topologies(7)))
    flags = ", ".join(f"coalesce(bit_or(CASE WHEN l_quantity > 45 AND l_returnflag = '{f}' THEN 1 << (l_linenumber - 1) END), 0)::INTEGER" for f in "ANR")
    cut = "list_sort(list_distinct(list_filter(list_transform({s}, lambda x: least(x & p, ~x & p)), lambda y: bit_count(y) >= 2 AND bit_count(p & ~y) >= 2)))"
    return (f"WITH {TQ.SUP}, every(topology, s) AS (VALUES {every}), have AS (SELECT l_suppkey AS tree_id, [{flags}] AS parts FROM lineitem GROUP BY 1), "
            "own AS (SELECT tree_id, list(list_sum(list_transform(range(1, 8), lambda i: CASE WHEN split[i] = '1' THEN 1 << (i - 1) ELSE 0 END))::INTEGER) AS s FROM splits GROUP BY 1), "
            "part AS (SELECT tree_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS k FROM have), "
            f"mine AS (SELECT tree_id, k, p, {cut.format(s='own.s')} AS c FROM part JOIN own USING (tree_id)), "
            f"kept AS (SELECT p, {cut.format(s='every.s')} AS c, topology FROM (SELECT DISTINCT p FROM part) CROSS JOIN every), "
            "same AS (SELECT tree_id, topology FROM mine JOIN kept USING (p, c) GROUP BY 1, 2 HAVING count(*) = 3) "
            "SELECT h.tree_id, CASE WHEN bit_count(parts[1] & parts[2] & parts[3]) = 0 THEN NULL ELSE count(topology) END AS size FROM have h LEFT JOIN same USING (tree_id) GROUP BY h.tree_id, parts")


@query(_terrace_sql())
def terrace_size(spark, d):
    """Terrace of every supplier's tree; a line number has data for a return flag if it sold over 45 at once."""
    li = R.table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") > 45).alias("large"))
    bits = lambda k: F.concat(*[F.coalesce(F.max(F.when(F.col("large") & (F.col("l_linenumber") == k) & (F.col("l_returnflag") == f), "1")), F.lit("0")) for f in "ANR"])
    have = li.groupBy(F.col("l_suppkey").alias("tree_id")).agg(*[bits(k).alias(f"b{k}") for k in R.LINES])
    full = have.select("tree_id", F.map_from_arrays(F.array(*[F.lit(x) for x in TQ.LINES]), F.array(*[F.col(f"b{k}") for k in R.LINES])).alias("presence"))
    out = terraces.terrace_sizes(TQ.supplier_trees(spark, d).join(full, "tree_id"))
    return out.withColumn("size", F.col("size").cast("bigint"))


# -- whole commands on files derived from the tables -----------------------------------

def command(spark, text: str) -> dict:
    from cladeframe.plans.commands import run
    from cladeframe.plans.options import parse
    return run(spark, parse(text.split()))


def _event_file(spark, d) -> str:
    path = folder(spark)
    sinks.write_phylip(AlignmentView(R.event_sites(spark, d), R.EVENT_TAXA).sequence_chunks(1000), f"{path}/in")
    return path


def _newick_file(spark, trees) -> str:
    path = folder(spark)
    sinks.write_trees(trees, path)
    return path


def _fixed_tree(spark, path: str) -> str:
    spark.createDataFrame([(LK.EVENT_TREE,)], "value STRING").coalesce(1).write.text(f"{path}/tree")
    return f"{path}/tree"


@query(f"WITH {S.EVENT_SITES} SELECT pattern, count(*)::BIGINT AS weight FROM event_sites GROUP BY 1")
def cmd_parse(spark, d):
    path = _event_file(spark, d)
    command(spark, f"--parse --msa {path}/in --msa-format iphylip --model BIN --prefix {path}/out")
    return store.read_store(spark, f"{path}/out.cladeframe.rba").patterns.select("pattern", "weight")


@query(f"WITH {S.ORDER_SITES} SELECT 7::BIGINT AS taxa, count(*) FILTER (translate(pattern, '-N', '') = '')::BIGINT AS gap_columns, 0::BIGINT AS gap_taxa, 0::BIGINT AS duplicates FROM order_sites")
def cmd_check(spark, d):
    path = folder(spark)
    sinks.write_phylip(AlignmentView(R.order_sites(spark, d).withColumn("part_id", F.lit(0)), R.LINE_TAXA).sequence_chunks(1000), path)
    out = command(spark, f"--check --msa {path} --msa-format iphylip --model GTR --nofiles")
    row = (out["taxa"], out["gap_columns"], len(out["gap_taxa"]), len(out["duplicates"]))
    return spark.createDataFrame([row], "taxa BIGINT, gap_columns BIGINT, gap_taxa BIGINT, duplicates BIGINT")


@query()
def cmd_start(spark, d):
    path = _event_file(spark, d)
    return command(spark, f"--start --msa {path}/in --msa-format iphylip --model BIN --tree rand{{3}},pars{{3}} --seed 1 --prefix {path}/out")["trees"]


@query(f"WITH {LK._BIN} SELECT round(sum(weight * ln(0.5 * (r_0_0 + r_0_1))), 4) AS loglh FROM f")
def cmd_loglh(spark, d):
    path = _event_file(spark, d)
    out = command(spark, f"--loglh --msa {path}/in --msa-format iphylip --model BIN+FE --tree {_fixed_tree(spark, path)}")
    return out["ml_trees"].select(F.round("loglh", 4).alias("loglh"))


@query(f"WITH {TQ.MON}, {TQ._RF} SELECT round(avg(rf),6) AS avg_rf, round(avg(rf)/44.0,6) AS avg_rrf, {TQ._UNIQ} AS unique_trees FROM rf")
def cmd_rfdist(spark, d):
    path = _newick_file(spark, TQ.month_trees(spark, d))
    s = command(spark, f"--rfdist --tree {path} --prefix {path}-out")["summary"]
    return s.select(F.round("avg_rf", 6).alias("avg_rf"), F.round("avg_rrf", 6).alias("avg_rrf"), "unique_trees")


@query(f"WITH {TQ.MON} SELECT count(DISTINCT split)::BIGINT AS n_splits, sum(n)::BIGINT AS support FROM (SELECT split, count(*) AS n FROM splits GROUP BY 1 HAVING count(*) > 6)")
def cmd_consense(spark, d):
    """Counts only: taxa are ordered as in the first tree, so split strings depend on it."""
    path = _newick_file(spark, TQ.month_trees(spark, d))
    c = command(spark, f"--consense MR --tree {path} --prefix {path}-out")["splits"]
    return c.agg(F.countDistinct("split").alias("n_splits"), F.sum("n").alias("support"))


@query(f"""WITH {TQ.SEG}, {TQ._REF}, t AS (SELECT count(DISTINCT tree_id) AS t FROM counts),
d AS (SELECT r.split, s.tree_id, min(least({TQ._HAM}, 25 - {TQ._HAM})) AS d FROM ref r CROSS JOIN splits s GROUP BY 1,2),
p AS (SELECT split, tree_id, d, least(length(replace(split,'0','')), length(replace(split,'1',''))) AS p FROM d)
SELECT 'fbp' AS metric, split, floor((SELECT count(*) FROM splits s WHERE s.split = ref.split)::DOUBLE / t * 100 + 0.5) AS support FROM ref, t
UNION ALL SELECT 'tbe', split, round(1 - avg(least(d, p - 1)) / (p - 1), 5) FROM p GROUP BY split, p""")
def cmd_support(spark, d):
    """Both supports as the command writes them into the reference tree."""
    ref = _newick_file(spark, TQ._reference(spark, d))
    reps = _newick_file(spark, TQ.segment_trees(spark, d))
    out = command(spark, f"--support --tree {ref} --bs-trees {reps} --bs-metric fbp,tbe --prefix {ref}-out")["support"]
    told = lambda m: TQ.labelled_splits(out[m], TQ.NATIONS).select(F.lit(m).alias("metric"), "split", F.round(F.col("label").cast("double"), 5).alias("support"))
    return told("fbp").unionByName(told("tbe"))


@query()
def cmd_bsconverge(spark, d):
    path = _newick_file(spark, TQ.supplier_trees(spark, d))
    return command(spark, f"--bsconverge --bs-trees {path} --prefix {path}-out --seed 1")["bootstop"]


@query(f"WITH {S.EVENT_SITES} SELECT r::INTEGER AS replicate, (SELECT count(*) FROM event_sites)::BIGINT AS sites FROM (SELECT unnest(range(0,4)) AS r)")
def cmd_bsmsa(spark, d):
    path = _event_file(spark, d)
    w = command(spark, f"--bsmsa --msa {path}/in --msa-format iphylip --model BIN --bs-trees 4 --seed 2 --prefix {path}/out")["weights"]
    return w.groupBy("replicate").agg(F.sum("weight").alias("sites"))


@query(f"WITH {S.EVENT_SITES} SELECT n::INTEGER AS node, (SELECT count(*) FROM event_sites)::BIGINT AS sites FROM (SELECT unnest(range(0,3)) AS n)")
def cmd_ancestral(spark, d):
    path = _event_file(spark, d)
    out = command(spark, f"--ancestral --msa {path}/in --msa-format iphylip --model BIN+FE --opt-model off --opt-branches off "
                         f"--tree {_fixed_tree(spark, path)} --prefix {path}/out")
    return out["sequences"].groupBy("node").agg(F.sum(F.length("segment")).alias("sites"))


@query("SELECT 1::BIGINT AS size")
def cmd_terrace(spark, d):
    """Every event type has data in both halves of the columns, so the tree is alone on its terrace."""
    path = _event_file(spark, d)
    n = R.event_sites(spark, d).count()
    scheme = f"BIN, a = 1-{n // 2}\nBIN, b = {n // 2 + 1}-{n}"
    spark.createDataFrame([(scheme,)], "value STRING").coalesce(1).write.text(f"{path}/scheme")
    out = command(spark, f"--terrace --msa {path}/in --msa-format iphylip --model {path}/scheme --brlen unlinked "
                         f"--tree {_fixed_tree(spark, path)} --prefix {path}/out")
    return spark.createDataFrame([(out["size"],)], "size BIGINT")


@query()
def cmd_all(spark, d):
    """All in one by its defaults: 20 starts, replicates until they converge or are 1,000."""
    path = _event_file(spark, d)
    out = command(spark, f"--all --msa {path}/in --msa-format iphylip --model BIN+FE --seed 1 --prefix {path}/out")
    return out["support"]["fbp"]
