import os
import re

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import sites as S
from cladeframe.operators.partitions import AlignmentView, split_by_ranges
from cladeframe.sources import alignments as A
from cladeframe.sources import schemes, sinks, store, trees

SEQS = {"t1": "ACGTACGTAC", "t2": "ACGTTCGTAC", "t3": "AC-TACNTAC", "t4": "GCGTACGTAA"}


def cols():
    return ["".join(s[i] for s in SEQS.values()) for i in range(10)]


def patterns_of(al):
    return [r["pattern"] for r in al.sites.orderBy("site").collect()]


def write(tmp_path, text, name="x"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta(spark, tmp_path):
    text = "".join(f">{n}  \n{s[:4]}\n{s[4:]}\n" for n, s in SEQS.items())
    al = A.read_alignment(spark, write(tmp_path, text))
    assert al.labels == list(SEQS) and patterns_of(al) == cols()
    with pytest.raises(A.FormatError):
        A.read_fasta(spark, write(tmp_path, ">a\nAC\n>b\nACG\n", "bad"))
    with pytest.raises(A.FormatError):
        A.read_fasta(spark, write(tmp_path, ">a\nAC\n>\nAC\n", "bad2"))


def test_phylip_layouts(spark, tmp_path):
    one = "4 10\n" + "".join(f"{n} {s}\n" for n, s in SEQS.items())
    seq = "4 10\n" + "".join(f"{n} {s[:5]}\n{s[5:]}\n" for n, s in SEQS.items())
    inter = "4 10\n" + "".join(f"{n} {s[:5]}\n" for n, s in SEQS.items()) + "\n" + "".join(f"{s[5:]}\n" for s in SEQS.values())
    for k, (text, want) in enumerate(((one, "phylip"), (seq, "phylip"), (inter, "iphylip"))):
        path = write(tmp_path, text, f"p{k}")
        assert A.sniff(spark, path) == want
        al = A.read_alignment(spark, path)
        assert al.labels == list(SEQS) and patterns_of(al) == cols()
    with pytest.raises(A.FormatError):
        A.read_phylip(spark, write(tmp_path, one.replace("4 10", "4 11"), "bad"))


def test_catg(spark, tmp_path):
    rows = ["3 2", "a b c", "AMT 0,1,0,0 0.5,0.5,0,0 0,0,1,0", "AAA 0,1,0,0 0,1,0,0 0,1,0,0"]
    al = A.read_alignment(spark, write(tmp_path, "\n".join(rows) + "\n"))
    assert al.labels == ["a", "b", "c"] and patterns_of(al) == ["AMT", "AAA"]
    got = {(r.site, r.taxon_id): list(r.probs) for r in al.probs.collect()}
    assert got[0, 0] == [1, 0, 0, 0] and got[0, 1] == [0.5, 0.5, 0, 0] and got[0, 2] == [0, 0, 0, 1]
    assert S.probabilities_normalised(al.probs).first()[0]


def test_vcf_is_rejected(spark, tmp_path):
    with pytest.raises(NotImplementedError):
        A.read_alignment(spark, write(tmp_path, "##fileformat=VCFv4.2\n"))


def test_phylip_round_trip(spark, tmp_path):
    al = A.read_alignment(spark, write(tmp_path, "4 10\n" + "".join(f"{n} {s}\n" for n, s in SEQS.items())))
    out = str(tmp_path / "out")
    sinks.write_phylip(AlignmentView(al.sites, al.labels).sequence_chunks(4), out)
    back = A.read_phylip(spark, out, interleaved=True)
    assert back.labels == al.labels and patterns_of(back) == cols()
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_phylip(AlignmentView(al.sites, al.labels).sequence_chunks(4), out)


def test_store_prunes(spark, tmp_path):
    al = A.read_alignment(spark, write(tmp_path, "4 10\n" + "".join(f"{n} {s}\n" for n, s in SEQS.items())))
    split = split_by_ranges(al.sites.withColumn("site", F.col("site") + 1), [(0, 1, 4, 1), (1, 5, 10, 1)])
    path = str(tmp_path / "store")
    store.write_store(al, S.compress_patterns(split), path, ["a", "b"])
    back = A.read_alignment(spark, path)
    assert back.labels == al.labels and back.patterns.agg(F.sum("weight")).first()[0] == 10
    one = store.read_store(spark, path, [1])
    assert one.patterns.agg(F.sum("weight")).first()[0] == 6
    assert re.search(r"PartitionFilters: \[[^\]]*part_id", one.patterns._jdf.queryExecution().toString())


def test_scheme(spark):
    text = "GTR+FU{0.1/0.2/0.3/0.4} , p1 = 1-4\r\n\nHKY, p2=5-10\\2, 6-10/2\n"
    parts = schemes.parse_scheme(text)
    assert [(p.name, p.model) for p in parts] == [("p1", "GTR+FU{0.1/0.2/0.3/0.4}"), ("p2", "HKY")]
    assert schemes.scheme_ranges(spark, parts) == [(0, 1, 4, 1), (1, 5, 10, 2), (1, 6, 10, 2)]
    assert schemes.write_scheme(parts, lengths={0: 4, 1: 6}).splitlines()[1] == "HKY, p2 = 5-10"
    with pytest.raises(ValueError, match="line 2"):
        schemes.parse_scheme("GTR, a = 1-2\nbroken\n")


def test_split_errors(spark):
    df = spark.range(1, 6).select(F.lit(0).alias("part_id"), F.col("id").alias("site"), F.lit("ACGT").alias("pattern"))
    for ranges in ([(0, 1, 3, 1)], [(0, 1, 5, 1), (1, 5, 5, 1)]):
        with pytest.raises(Exception, match="not covered exactly once"):
            split_by_ranges(df, ranges).collect()


def test_trees_and_names(spark, tmp_path):
    a = write(tmp_path, "(a:0.1,b:0.2,(c,d)90:0.3);\n((a,b),(c,d));\n", "a.nw")
    b = write(tmp_path, "(a,c,(b,d));", "b.nw")
    t = trees.read_trees(spark, f"{a},{b}").orderBy("tree_id").collect()
    assert [r.tree_id for r in t] == [0, 1, 2] and t[0].newick.endswith(",(c,d)90:0.3);")
    assert schemes.output_name("best_tree", "run") == "run.cladeframe.bestTree"
    assert schemes.output_name("best_tree", "", "x.fa", True) == ""


def test_run_store(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path / "ck"))
    assert s.load("ml") is None and not s.done("ml", 0)
    s.save("ml", 0, spark.createDataFrame([(1, -5.0, "x")], "tree_id BIGINT, loglh DOUBLE, newick STRING"))
    assert s.done("ml", 0) and s.load("ml").count() == 1
    s.clear()
    assert s.load("ml") is None


def test_registry_without_corpus_libraries():
    """A missing library of the optional part costs only that part."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.modules['public_tokenizers'] = None; sys.path.insert(0, sys.argv[1])\n"
            "import warnings; warnings.simplefilter('ignore')\nimport __spark_entry__ as e\n"
            "q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') and k[2].isdigit() for k in q), len(q)\nassert set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code, root], check=True, cwd="/", timeout=120)


def test_tasks_find_the_package_from_another_folder(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "own.py"
    script.write_text(f"import sys; sys.path.insert(0, {root!r})\nfrom cladeframe.session import get_spark\nfrom cladeframe.operators import trees as T\n"
                      "s = get_spark(2, memory='1g')\nt = s.createDataFrame([(1, '((a,b),c,d);')], 'tree_id BIGINT, newick STRING')\n"
                      "assert [r.split for r in T.tree_splits(t, list('abcd')).collect()] == ['0011']\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, str(script)], check=True, cwd=tmp_path, env=env, timeout=240)


def test_functions_for_sql(spark):
    """Nulls give no rows or null; texts and taxa may come from columns."""
    from cladeframe.functions import registered

    registered.register(spark)
    t = spark.createDataFrame([(1, "((a:1,b:2)x:0.5,c:1,d:1);"), (2, None), (3, "(a,b,(c,d));")], "id INT, newick STRING")
    got = spark.sql("SELECT t.id, s.* FROM {t} t, LATERAL newick_splits(t.newick, 'a,b,c,d') s", t=t).collect()
    assert {(r.id, r.split, r.length, r.label) for r in got} == {(1, "0011", 0.5, "x"), (3, "0011", None, "")}
    m = spark.sql("SELECT m.* FROM (SELECT explode(array('GTR+G', NULL, 'LG')) AS x) v, LATERAL parse_model(v.x) m").collect()
    assert {(r.name, r.states, r.categories, r.free_params) for r in m} == {("GTR", 4, 4, 9), ("LG", 20, 1, 0)}
    p = spark.createDataFrame([("AAAA", "JC"), ("ACGT", "JC"), ("AC-T", "HKY{1/2}+FE"), (None, "JC"), ("AAAA", None)], "pattern STRING, model STRING")
    lnl = {(r.pattern, r.model): r.l for r in spark.sql("SELECT pattern, model, pattern_loglh(pattern, 'a,b,c,d', '((a:0.1,b:0.1):0.1,c:0.1,d:0.1);', model) AS l FROM {p}", p=p).collect()}
    assert lnl[None, "JC"] is None and lnl["AAAA", None] is None
    assert lnl["AAAA", "JC"] > lnl["ACGT", "JC"] and lnl["AC-T", "HKY{1/2}+FE"] < 0


def test_layout_of_lines_longer_than_the_first_bytes(spark, tmp_path):
    wide = 5000
    block = ["".join("ACGT"[(i * 7 + j) % 4] for j in range(wide)) for i in range(4)]
    (tmp_path / "inter.phy").write_text(f"4 {2 * wide}\n" + "".join(f"t{i} {x}\n" for i, x in enumerate(block)) + "\n".join(block) + "\n")
    (tmp_path / "seq.phy").write_text(f"4 {2 * wide}\n" + "".join(f"t{i} {x}\n{x}\n" for i, x in enumerate(block)))
    for name, kind in (("inter", "iphylip"), ("seq", "phylip")):
        path = f"{tmp_path}/{name}.phy"
        assert A.sniff(spark, path) == kind
        al = A.read_alignment(spark, path)
        assert al.labels == ["t0", "t1", "t2", "t3"] and al.sites.count() == 2 * wide


def test_written_probabilities_are_rounded_once(spark, sf, monkeypatch):
    from cladeframe.plans.catalog import files
    from cladeframe.plans import recipes as R

    def states(*_):
        p = R.line_sites(spark, sf).select("part_id", "pattern").distinct()
        return p.selectExpr("0 AS node", "part_id", "pattern", "'A' AS state", "array(0.85554999996D, 0.1D, 0.02D, 0.02445000004D) AS probs")

    monkeypatch.setattr(files.L, "ancestral_states", states)
    assert [r[0] for r in files.sink_ancestral_probs(spark, sf).select("p_A").distinct().collect()] == ["0.8555"]
