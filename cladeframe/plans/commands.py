"""The commands: compose sources, operators and fitting into complete analyses.

``run(spark, options)`` returns a dict of DataFrames and scalars and, unless files are
switched off, writes them under the output prefix.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import cladeframe
from cladeframe.functions import newick as nw
from cladeframe.functions.models import Model, check_model, parse_model, total_free_params
from cladeframe.operators import bootstrap as BS
from cladeframe.operators import checks as C
from cladeframe.operators import halves as H
from cladeframe.operators import likelihood as L
from cladeframe.operators import sites as S
from cladeframe.operators import terraces as TR
from cladeframe.operators import trees as T
from cladeframe.operators import treesets as TS
from cladeframe.operators.partitions import AlignmentView, split_by_ranges
from cladeframe.operators.scoring import ELEMENTS_PER_CORE, cores_for, ic_scores, memory_bytes
from cladeframe.plans import inference as I
from cladeframe.plans.checkpoint import Checkpoint
from cladeframe.plans.options import Options, usage
from cladeframe.sources import schemes, sinks
from cladeframe.sources.alignments import Alignment, read_alignment
from cladeframe.sources.schemes import Part, output_name
from cladeframe.sources.store import RunStore, write_store
from cladeframe.sources.text import exists
from cladeframe.session import parallelism
from cladeframe.sources.trees import read_trees

log = logging.getLogger("cladeframe")
#: Replicates of the first batch; batches grow while the weights of one take no more than this many bytes a core.
BS_BATCH, BS_BYTES = 50, 256 << 20


class Job:
    """Loaded alignment with partitions and models; the tables stay lazy."""

    opened: list[Job] = []

    def __init__(self, spark: SparkSession, o: Options):
        self.spark, self.o = spark, o
        self.al: Alignment = read_alignment(spark, o.msa, o.msa_format)
        self.labels = self.al.labels
        is_file = exists(spark, o.model) if "{" not in o.model else False
        self.parts = schemes.read_scheme(spark, o.model) if is_file else [Part(0, "noname", o.model, "")]
        self.models: dict[int, Model] = {p.part_id: parse_model(p.model, o.data_type) for p in self.parts}
        if len(self.parts) == 1:
            o.brlen = "linked"
        sites = self.al.sites
        if self.al.patterns is None:
            one_based = sites.withColumn("site", F.col("site") + 1)
            if is_file:
                sites = split_by_ranges(one_based, schemes.scheme_ranges(spark, self.parts))
            else:
                sites = one_based.withColumn("part_id", F.lit(0))
        if self.al.probs is not None and o.prob_msa and len(self.parts) > 1:
            raise ValueError("a probabilistic alignment cannot be partitioned")
        # every check and statistic reads the columns again; text is parsed and transposed once
        self.sites = sites.persist(StorageLevel.MEMORY_AND_DISK)
        Job.opened.append(self)

    def alphabets(self) -> dict:
        return {p: m.alphabet for p, m in self.models.items()}

    def patterns(self) -> DataFrame:
        """Compressed columns, each partition under its own alphabet; gap columns are dropped."""
        if self.al.patterns is not None:
            return self.al.patterns
        w = "weight" if "weight" in self.sites.columns else None

        def step(sites, alphabet):
            s = S.drop_gap_columns(sites, alphabet)
            if self.o.pat_comp:
                return S.compress_patterns(s, alphabet, w)
            return s.select("part_id", "pattern", (F.col(w) if w else F.lit(1)).cast("bigint").alias("weight"), F.col("site").alias("first_site"))

        return _by_alphabet(self, step)

    def probable(self) -> bool:
        """Whether likelihoods come from probability vectors and not from symbols."""
        return self.al.vectors is not None and self.o.prob_msa

    def fitted(self, stats: dict[int, dict]) -> dict[int, Model]:
        return {p: m.with_stats(stats[p]["base_freqs"], stats[p]["inv_prop"], self._rates(p, m)) for p, m in self.models.items()}

    def _rates(self, p: int, m: Model):
        if m.mode["rates"] != "empirical":
            return None
        rows = S.empirical_rates(self.patterns().where(F.col("part_id") == p), m.alphabet).orderBy("pair").collect()
        return [r["rate"] for r in rows]

    def check_tree(self, t: L.Topology) -> None:
        if {v for v in t.near if v < t.tips} != set(range(len(self.labels))):
            raise ValueError("the tree and the alignment have different taxa")
        if any(x < 0 for v in t.near for x in t.near[v].values()):
            raise ValueError("negative branch length")

    def name(self, kind: str) -> str:
        return output_name(kind, self.o.prefix, self.o.msa, self.o.nofiles)

    def constraint(self) -> I.Constraint | None:
        if not self.o.constraint:
            return None
        text = read_trees(self.spark, self.o.constraint).first()["newick"]
        t = nw.parse(text)
        tips = {t.label[v] for v in t.tips()}
        unknown = tips - set(self.labels)
        if unknown:
            raise ValueError(f"constraint taxa missing from the alignment: {sorted(unknown)}")
        if t.is_binary() and tips == set(self.labels) and self.o.force is None:
            raise ValueError("the constraint is fully resolved and comprehensive: nothing is left to search")
        return I.Constraint(text, self.labels)


class InvalidCharacters(ValueError):
    """``cells`` is the table of all of them: (part_id, site, taxon_id, symbol)."""

    def __init__(self, message: str, cells: DataFrame):
        super().__init__(message)
        self.cells = cells


def _by_alphabet(job: Job, step) -> DataFrame:
    """``step(sites, alphabet)`` over all partitions, with one branch for each alphabet, not for each partition."""
    groups: dict = {}
    for p, a in job.alphabets().items():
        groups.setdefault((a.states, tuple(sorted(a.masks.items()))), (a, []))[1].append(p)
    every = [step(job.sites.where(F.col("part_id").isin(ids)), a) for a, ids in groups.values()]
    return reduce(DataFrame.unionByName, every)


def validate(job: Job) -> dict:
    """All alignment checks; raises on errors, returns warnings and the reduced view."""
    o, active = job.o, job.o.checks()
    if len(job.labels) < C.MIN_TAXA:
        raise ValueError("the alignment contains fewer than 4 sequences")
    dup = sorted({x for x in job.labels if job.labels.count(x) > 1}) if len(set(job.labels)) < len(job.labels) else []
    if dup:
        raise ValueError(f"duplicate sequence names: {dup}")
    fixed = {x: "".join("_" if c in C.RESERVED else c for c in x) for x in job.labels if any(c in C.RESERVED for c in x)}
    out: dict = {"invalid_names": fixed if "msa_names" in active else {}}
    bad = _by_alphabet(job, C.invalid_cells)
    where = bad.select(F.struct("site", "taxon_id", "symbol", "part_id").alias("w")).agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if where["n"]:
        table = None if o.nofiles else job.name("invalid")
        if table:
            bad.repartitionByRange("site", "taxon_id").sortWithinPartitions("site", "taxon_id").select(
                (F.col("taxon_id") + 1).alias("sequence"), (F.col("site")).alias("position"), "symbol").write.mode(
                "overwrite" if o.redo else "errorifexists").option("sep", "\t").option("header", True).csv(table)
        r = where["w"]
        raise InvalidCharacters(f"invalid character {r['symbol']!r} in sequence {r['taxon_id'] + 1} at position {r['site']} "
                                f"({where['n']} in total{f', all in {table}' if table else ''})", bad)
    raw = S.compress_patterns(job.sites, weight="weight" if "weight" in job.sites.columns else None)
    gaps = C.undetermined_taxa(raw, job.alphabets()) if "msa_allgaps" in active else []
    pairs = C.identical_taxa(raw, len(job.labels)) if "msa_dups" in active else []
    pairs = [(a, b) for a, b in pairs if a not in gaps and b not in gaps]
    gap_cols = _by_alphabet(job, S.gap_columns).select("part_id", "site")
    n_gap = gap_cols.count() if "msa_allgaps" in active else 0
    view = AlignmentView(job.sites, job.labels).rename(out["invalid_names"]).exclude_taxa(set(gaps) | {b for _, b in pairs})
    if n_gap:
        view = view.exclude_sites(gap_cols)
    out.update({"gap_columns": n_gap, "gap_taxa": [job.labels[i] for i in gaps],
                "duplicates": [(job.labels[a], job.labels[b]) for a, b in pairs], "reduced": None if view.identity else view})
    if not view.identity and not o.nofiles:
        sinks.write_phylip(view.sequence_chunks(), f"{o.prefix or o.msa}.{schemes.TAG}.reduced.phy", o.redo)
    if out["invalid_names"]:
        raise ValueError(f"taxon names with reserved characters: {sorted(out['invalid_names'])}")
    return out


def check_models(job: Job, stats: dict[int, dict], branches: int) -> list[str]:
    active, notes = job.o.checks(), []
    for p, m in job.models.items():
        problems = check_model(m, len(job.parts), job.o.brlen)
        if problems and ("model_lg4_freqs" in active or "model_invalid_freqs" in active):
            raise ValueError("; ".join(problems))
        if "model_zero_freqs" in active and m.mode["freqs"] == "empirical" and min(stats[p]["base_freqs"]) < 1e-3:
            notes.append(f"partition {p}: a state is (almost) absent")
        if m.asc and stats[p]["inv_prop"] > 0:
            raise ValueError(f"partition {p}: ascertainment correction with {stats[p]['inv_count']} invariant columns")
        if "model_overfit" in active and len(job.parts) > 1:
            n, k = stats[p]["site_count"], m.free_params()
            if k >= n or (job.o.brlen == "unlinked" and k + branches >= n):
                raise ValueError(f"partition {p}: {k} parameters for {n} columns")
            if k + branches >= n:
                notes.append(f"partition {p}: nearly as many parameters as columns")
    return notes


def prepare(spark: SparkSession, o: Options, extra=None, replicates: int = 0):
    job = Job(spark, o)
    validate(job)
    if job.probable():
        al = _packed_vectors(job)
    else:
        al = L.pack(job.patterns(), job.labels, job.models, extra(job) if extra else None, replicates)
    try:
        notes = check_models(job, al.stats, 2 * len(job.labels) - 3)
    except ValueError:
        al.close()
        raise
    for note in notes:
        log.warning(note)
    return job, al


def _packed_vectors(job: Job) -> L.PackedAlignment:
    """Blocks of probability vectors; frequencies of states are their means."""
    stats = L.statistics(job.patterns(), job.models)
    freqs = S.probability_freqs(job.al.probs).orderBy("state_no").collect()
    total = sum(r["freq"] for r in freqs)
    if total > 0:
        stats[0]["base_freqs"] = [r["freq"] / total for r in freqs]
    return L.pack_vectors(job.al.vectors, job.labels, stats)


# -- starting trees ---------------------------------------------------------------------

def start_trees(job: Job, al: L.PackedAlignment) -> list[L.Topology]:
    o, out = job.o, []
    c = job.constraint()
    if o.start_trees.get("user") and o.tree:
        rows = read_trees(job.spark, o.tree).orderBy("tree_id").collect()
        out += [L.Topology.from_newick(r["newick"], job.labels) for r in rows]
    n = o.start_trees.get("random", 0)
    if n:
        ids = job.spark.range(n).select(F.col("id").alias("tree_id"))
        text = read_trees(job.spark, o.constraint).first()["newick"] if o.constraint else None
        rows = T.random_trees(ids, job.labels, o.seed, text).orderBy("tree_id").collect()
        out += [L.Topology.from_newick(r["newick"], job.labels) for r in rows]
    n = o.start_trees.get("parsimony", 0)
    if n:
        symbols = L.pack(job.patterns(), job.labels, job.models) if job.probable() else al  # parsimony takes the consensus
        out += [t for t, _ in I.parsimony_trees(symbols, job.alphabets(), range(o.seed, o.seed + n))]
        if symbols is not al:
            symbols.close()
    for t in out:
        job.check_tree(t)
        if c and not c.allows(t):
            raise ValueError("a starting tree violates the constraint")
    return out


def _frame(job: Job, trees) -> DataFrame:
    return job.spark.createDataFrame([(i, t.newick(job.labels, job.o.precision)) for i, t in enumerate(trees)], "tree_id BIGINT, newick STRING")


def _put(job_or_opts, kind: str, df: DataFrame) -> None:
    o = job_or_opts.o if isinstance(job_or_opts, Job) else job_or_opts
    path = output_name(kind, o.prefix, o.msa, o.nofiles)
    if path:
        sinks.write_trees(df, path, o.redo)


def cmd_start(spark, o: Options) -> dict:
    job, al = prepare(spark, o)
    trees = _frame(job, start_trees(job, al))
    al.close()
    _put(job, "start_tree", trees)
    return {"trees": trees}


def cmd_check(spark, o: Options) -> dict:
    job = Job(spark, o)
    return {"taxa": len(job.labels), "partitions": len(job.parts), **validate(job)}


def cmd_parse(spark, o: Options) -> dict:
    """Check, compress, store; and estimate memory and cores."""
    job = Job(spark, o)
    out = validate(job)
    p = job.patterns()
    stats = L.statistics(p, job.models)
    if not o.nofiles:
        write_store(job.al, p, job.name("binary_msa"), [f"{x.model}, {x.name} = {x.ranges}" for x in job.parts], overwrite=o.redo)
    rows = [(k, len(job.labels), s["pattern_count"], job.models[k].states, job.models[k].ncat) for k, s in stats.items()]
    df = spark.createDataFrame(rows, "part_id INT, taxa BIGINT, patterns BIGINT, states BIGINT, cats BIGINT")
    mem = memory_bytes(F.col("taxa"), F.col("patterns"), F.col("states"), F.col("cats"), o.tip_inner)
    total = df.agg(F.sum(mem).alias("memory"), F.sum(F.col("patterns") * F.col("states") * F.col("cats")).cast("double").alias("clv"))
    est = total.select("memory", *[cores_for(F.col("clv"), g).alias(g) for g in ELEMENTS_PER_CORE])
    return {**out, "stats": stats, "estimate": est, "patterns": p}


# -- likelihood commands ----------------------------------------------------------------

def _searches(job: Job, al, trees) -> list[I.Search]:
    models = job.fitted(al.stats)
    return [I.Search(i, t, dict(models), limits=(job.o.blmin, job.o.blmax)) for i, t in enumerate(trees)]


def _scored(job: Job, ss) -> DataFrame:
    return job.spark.createDataFrame([(s.search_id, float(s.loglh), s.tree.newick(job.labels, job.o.precision)) for s in ss],
                                     "tree_id BIGINT, loglh DOUBLE, newick STRING")


def _report(job: Job, al, best: I.Search) -> dict:
    k = total_free_params(list(best.models.values()), 2 * len(job.labels) - 3, job.o.brlen)
    n = sum(s["site_count"] for s in al.stats.values())
    row = job.spark.createDataFrame([(float(best.loglh), k, n)], "loglh DOUBLE, free_params BIGINT, sites BIGINT")
    texts = {p: m.text(True, job.o.precision) for p, m in best.models.items()}
    out = {"loglh": float(best.loglh), "scores": ic_scores(row), "models": texts,
           "newick": best.tree.newick(job.labels, job.o.precision)}
    if not job.o.nofiles:
        job.spark.createDataFrame([(f"{texts[p.part_id]}, {p.name} = {p.ranges or f'1-{n}'}",) for p in job.parts], "value STRING").coalesce(
            1).write.mode("overwrite" if job.o.redo else "errorifexists").text(job.name("best_model"))
        if best.lengths:
            rows = []
            for p, own in sorted(best.lengths.items()):
                rows.append((p, best.tree.set_lengths(own).newick(job.labels, job.o.precision)))
            _put(job, "partition_trees", job.spark.createDataFrame(rows, "tree_id BIGINT, newick STRING"))
    return out


def _drawn(job: Job, trees: DataFrame) -> DataFrame:
    """Rooted on the outgroup if one is given (drawing only)."""
    if not job.o.outgroup:
        return trees
    unknown = set(job.o.outgroup) - set(job.labels)
    if unknown:
        raise ValueError(f"outgroup taxa missing from the alignment: {sorted(unknown)}")
    return T.reroot(trees, job.o.outgroup, precision=job.o.precision)


def _finish(job: Job, al, ss) -> dict:
    scored = _scored(job, ss)
    best = max(ss, key=lambda s: (s.loglh, -s.search_id))
    out = {"ml_trees": scored, "best_tree": _drawn(job, T.best_tree(scored)), "best": best, **_report(job, al, best)}
    _put(job, "best_tree", out["best_tree"].withColumn("tree_id", F.lit(0)))
    if len(ss) > 1:
        _put(job, "ml_trees", scored)
    return out


def cmd_evaluate(spark, o: Options) -> dict:
    job, al = prepare(spark, o)
    rows = read_trees(spark, o.tree).orderBy("tree_id").collect()
    ss = _searches(job, al, [L.Topology.from_newick(r["newick"], job.labels) for r in rows])
    for s in ss:
        job.check_tree(s.tree)
    I.evaluate(al, ss, o.lh_epsilon, o.brlen, o.opt_model, o.opt_branches)
    out = _finish(job, al, ss)
    al.close()
    return out


def cmd_search(spark, o: Options) -> dict:
    """Searches run in step; a run that was stopped goes on from its last step, a finished one is kept in the run store and not repeated."""
    job, al = prepare(spark, o)
    store = RunStore(spark, job.name("checkpoint")) if not o.nofiles else None
    if store and o.redo:
        store.clear()
    if store and store.done("ml", 0):
        rows = store.load("ml").orderBy("tree_id").collect()
        ss = _searches(job, al, [L.Topology.from_newick(r["newick"], job.labels) for r in rows])
        I.evaluate(al, ss, o.lh_epsilon, o.brlen, o.opt_model, o.opt_branches)
    else:
        state = Checkpoint(spark, store.path) if store else None
        ss = _searches(job, al, start_trees(job, al))
        I.search(al, ss, o.lh_epsilon, o.brlen, o.spr_radius, job.constraint(),
                 on_step=lambda step, x: log.info("%s: best %.6f", step, max(s.loglh for s in x)), fit_models=o.opt_model, cutoff=max(0.0, o.spr_cutoff), checkpoint=state)
        if store:
            store.save("ml", 0, _scored(job, ss))
    out = _finish(job, al, ss)
    if store:
        store.clear()
    al.close()
    return {**out, "job": job}


def cmd_ancestral(spark, o: Options) -> dict:
    job, al = prepare(spark, o)
    if len({m.datatype_name for m in job.models.values()}) > 1:
        raise ValueError("ancestral states need one data type for all partitions")
    rows = read_trees(spark, o.tree).orderBy("tree_id").limit(1).collect()
    ss = _searches(job, al, [L.Topology.from_newick(rows[0]["newick"], job.labels)])
    I.evaluate(al, ss, o.lh_epsilon, o.brlen, o.opt_model, o.opt_branches)
    best = ss[0]
    topo = best.tree
    alphabet = next(iter(job.models.values())).alphabet
    order, _ = topo.rooted()
    inner = sorted(v for v, _ in order)
    tree = topo.newick(job.labels, o.precision, {v: f"Node{k + 1}" for k, v in enumerate(inner)})
    compact = job.sites.select("part_id", "site", S.canonical_symbols(F.col("pattern"), alphabet).alias("pattern"))
    pats = compact.groupBy("part_id", "pattern").agg(F.count(F.lit(1)).alias("weight"))
    probs = L.ancestral_probs(pats, job.labels, topo, best.models)
    states = L.ancestral_states(probs, alphabet).join(compact, ["part_id", "pattern"]).select("node", "part_id", "site", "state", "probs")
    seqs = L.ancestral_sequences(states)
    if not o.nofiles:
        sinks.write_ancestral_probs(states, alphabet.states, job.name("asr_probs"), len(job.parts), o.redo, o.precision)
        sinks.write_ancestral_states(seqs, job.name("asr_states"), o.redo)
        _put(job, "asr_tree", spark.createDataFrame([(0, tree)], "tree_id BIGINT, newick STRING"))
    al.close()
    return {"probs": states, "sequences": seqs, "tree": tree, "loglh": best.loglh}


# -- bootstrap --------------------------------------------------------------------------

def _sizes(o: Options, patterns: int, cores: int):
    """(first replicate, number) of each batch: checks don't depend on them, as they are made at every interval inside."""
    most = max(BS_BATCH, int(BS_BYTES * cores // (8 * max(1, patterns))))
    at, n = 0, BS_BATCH
    while at < o.bootstraps:
        n = min(n, most, o.bootstraps - at)
        yield at, n
        at, n = at + n, 3 * (at + n)


def cmd_bootstrap(spark, o: Options, job: Job | None = None) -> dict:
    """Batches of replicates, all replicates of a batch in the same jobs; optional stopping.

    A replicate depends on the data, the seed and its number only, so batches may be of any size: each is three times as long as all
    before it.  With stopping, convergence is checked at every interval, and replicates after the first success are left out.  A
    finished batch is a committed directory, so a restart continues after it.
    """
    if job is None:
        job = Job(spark, o)
        validate(job)
    pats = job.patterns().persist()
    stats = L.statistics(pats, job.models)
    models = job.fitted(stats)
    store = RunStore(spark, f"{job.name('checkpoint') or o.msa + '.bs'}.bs") if not o.nofiles else None
    if store and o.redo:
        store.clear()
    done, report = [], None
    for first, n in _sizes(o, sum(s["pattern_count"] for s in stats.values()), parallelism(spark)):
        kept = store.load("bs") if store else None
        rows = []
        if kept is not None:
            kept = kept.where(F.col("tree_id").between(first, first + n - 1)).dropDuplicates(["tree_id"])
            rows = [(r["tree_id"], r["loglh"], r["newick"]) for r in kept.orderBy("tree_id").collect()]
        if len(rows) < n:
            w = BS.multinomial_weights(pats, n, o.seed, first)
            al = L.pack(pats, job.labels, job.models, w, n, stats=stats)
            starts = I.parsimony_trees(al, job.alphabets(), range(o.seed + first, o.seed + first + n), range(1, n + 1))
            ss = [I.Search(k, t, dict(models), k + 1, limits=(o.blmin, o.blmax)) for k, (t, _) in enumerate(starts)]
            I.search(al, ss, o.lh_epsilon, o.brlen, o.spr_radius, job.constraint(), fit_models=o.opt_model, cutoff=max(0.0, o.spr_cutoff))
            rows = [(first + s.search_id, float(s.loglh), s.tree.newick(job.labels, o.precision)) for s in ss]
            al.close()
            if store:
                store.save("bs", first, spark.createDataFrame(rows, "tree_id BIGINT, loglh DOUBLE, newick STRING"))
        done += rows
        if o.bootstop:
            due = [p for p in H.report_prefixes(len(done), o.bs_interval) if p > first and (p % o.bs_interval == 0 or p == o.bootstraps)]
            if due:
                trees = spark.createDataFrame(done, "tree_id BIGINT, loglh DOUBLE, newick STRING")
                row = _converged(trees, job.labels, due, o)
                report = row if report is None else report.unionByName(row)
                stop = row.where("converged").agg(F.min("trees")).first()[0]
                if stop is not None:
                    done = done[:stop]
                    break
    trees = spark.createDataFrame(done, "tree_id BIGINT, loglh DOUBLE, newick STRING")
    _put(job, "bootstrap_trees", trees)
    if store:
        store.clear()
    pats.unpersist()
    return {"bs_trees": trees, "bootstop": report, "job": job}


def _converged(trees: DataFrame, labels, prefixes, o: Options, until=True) -> DataFrame:
    s = T.tree_splits(trees, labels).select(F.col("tree_id").alias("tree_no"), "split")
    check = H.report if until else H.bootstop
    return check(s, trees.select(F.col("tree_id").alias("tree_no")), len(labels), prefixes, o.bs_permutations, o.bs_cutoff, o.seed)


def cmd_all(spark, o: Options) -> dict:
    ml = cmd_search(spark, o)
    bs = cmd_bootstrap(spark, o, ml["job"])
    out = {**ml, **bs}
    out["support"] = _support(spark, o, ml["newick"], bs["bs_trees"], bs["job"].labels)
    return out


# -- tree-set commands ------------------------------------------------------------------

def _tips(newick: str) -> list[str]:
    t = nw.parse(newick)
    return [t.label[v] for v in t.tips()]


def _binary(trees: DataFrame, what: str) -> DataFrame:
    bad = T.tree_shape(trees).where("NOT is_binary").limit(1).collect()
    if bad:
        raise ValueError(f"{what} {bad[0]['tree_id']} is multifurcating")
    return trees


def _same_taxa(trees: DataFrame, labels) -> None:
    taxa = trees.sparkSession.createDataFrame([(x,) for x in labels], "label STRING")
    bad = C.tree_taxa_mismatch(T.tree_tips(trees), taxa).limit(1).collect()
    if bad:
        raise ValueError(f"tree {bad[0]['tree_id']}: {bad[0]['problem']} taxon {bad[0]['label']}")


def _support(spark, o: Options, reference: str, trees: DataFrame, labels) -> dict:
    splits = T.tree_splits(trees, labels).select("tree_id", "split")
    ref = spark.createDataFrame([(s,) for s, _ in nw.splits(nw.parse(reference), {x: i for i, x in enumerate(labels)})], "split STRING")
    out = {}
    for metric in o.bs_metric:
        if metric == "fbp":
            s = TS.support_fbp(ref, splits, trees=trees)
            out[metric] = TS.draw_support(reference, s, labels)
        else:
            s = TS.support_tbe([r["split"] for r in ref.collect()], splits, trees)
            s = s.withColumn("text", F.format_string(f"%.{o.precision}f", F.col("support")))
            out[metric] = TS.draw_support(reference, s, labels, "text")
        kind = "support_tree" if len(o.bs_metric) == 1 else f"{metric}_support_tree"
        _put(o, kind, out[metric].withColumn("tree_id", F.lit(0)))
    return out


def cmd_support(spark, o: Options) -> dict:
    reference = read_trees(spark, o.tree).orderBy("tree_id").first()["newick"]
    trees = _binary(read_trees(spark, o.bs_trees_file), "replicate tree")
    labels = _tips(reference)
    _same_taxa(trees, labels)
    n = trees.count()
    out = {"support": _support(spark, o, reference, trees, labels)}
    if o.bootstop:
        out["bootstop"] = _converged(trees, labels, H.report_prefixes(n, o.bs_interval), o)
    return out


def cmd_bsconverge(spark, o: Options) -> dict:
    trees = _binary(read_trees(spark, o.bs_trees_file), "replicate tree")
    labels = _tips(trees.orderBy("tree_id").first()["newick"])
    _same_taxa(trees, labels)
    return {"bootstop": _converged(trees, labels, H.report_prefixes(trees.count(), o.bs_interval), o)}


def cmd_rfdist(spark, o: Options) -> dict:
    trees = _binary(read_trees(spark, o.tree), "tree")
    labels = _tips(trees.orderBy("tree_id").first()["newick"])
    _same_taxa(trees, labels)
    s = T.tree_splits(trees, labels).select("tree_id", "split")
    out = {"summary": TS.rf_average(trees, labels)}
    if not o.nofiles:
        out["pairs"] = TS.rf_pairwise(s, trees, len(labels))
        sinks.write_rf(out["pairs"], trees, output_name("rfdist", o.prefix), o.redo, o.precision)
    return out


def cmd_consense(spark, o: Options) -> dict:
    trees = _binary(read_trees(spark, o.tree), "tree")
    labels = _tips(trees.orderBy("tree_id").first()["newick"])
    _same_taxa(trees, labels)
    c = TS.consensus_splits(T.tree_splits(trees, labels).select("tree_id", "split"), trees.count(), len(labels), o.consense)
    tree = TS.consensus_tree(c, labels)
    path = output_name("cons_tree", o.prefix, "", o.nofiles)
    if path:
        sinks.write_trees(tree.withColumn("tree_id", F.lit(0)), f"{path}{o.consense}", o.redo)
    return {"splits": c, "tree": tree}


def cmd_bsmsa(spark, o: Options) -> dict:
    job = Job(spark, o)
    validate(job)
    p = job.patterns()
    w = BS.multinomial_weights(p, o.bootstraps, seed=o.seed)
    chunks = BS.replicate_chunks(w, p, len(job.labels))
    if not o.nofiles:
        sinks.write_replicates(chunks, job.labels, job.name("bootstrap_msa"), o.redo)
        if len(job.parts) > 1:
            n = {r["part_id"]: r["n"] for r in p.groupBy("part_id").agg(F.sum("weight").alias("n")).collect()}
            text = schemes.write_scheme(job.parts, lengths=n)
            spark.createDataFrame([(x,) for x in text.splitlines()], "value STRING").coalesce(1).write.mode(
                "overwrite" if o.redo else "errorifexists").text(f"{job.name('bootstrap_msa')}.partition")
    return {"weights": w, "chunks": chunks}


def cmd_terrace(spark, o: Options) -> dict:
    job = Job(spark, o)
    validate(job)
    if len(job.parts) < 2 or o.brlen != "unlinked":
        return {"size": None}
    text = read_trees(spark, o.tree).orderBy("tree_id").first()["newick"]
    cells = job.patterns().select("part_id", F.posexplode(F.split("pattern", "")).alias("taxon_id", "s"))
    known = F.lit(False)
    for p, a in job.alphabets().items():
        known = known | ((F.col("part_id") == p) & ~F.col("s").isin([c for c, m in a.masks.items() if m == a.full]))
    have = {(r["taxon_id"], r["part_id"]) for r in cells.where(known).select("taxon_id", "part_id").distinct().collect()}
    presence = {x: "".join("1" if (i, p.part_id) in have else "0" for p in job.parts) for i, x in enumerate(job.labels)}
    out = {"size": TR.terrace_size(spark, text, presence), "trees": TR.enumerate_terrace(text, presence, o.terrace_max)}
    out["listed"] = out["trees"] is not None
    out["compressed"] = TR.compressed(text, presence)
    if not o.nofiles and out["compressed"]:
        _put(job, "terrace_compressed", spark.createDataFrame([(0, out["compressed"])], "tree_id BIGINT, newick STRING"))
    if out["trees"]:
        _put(job, "terrace", spark.createDataFrame(list(enumerate(out["trees"])), "tree_id BIGINT, newick STRING"))
    return out


def run(spark: SparkSession, o: Options) -> dict:
    if o.command == "help":
        return {"text": usage()}
    if o.command == "version":
        return {"text": f"cladeframe {cladeframe.__version__}"}
    fn = {"loglh": cmd_evaluate, "search1": cmd_search, "rf": cmd_rfdist}.get(o.command) or globals()[f"cmd_{o.command}"]
    try:
        return fn(spark, o)
    finally:
        # a cached plan would also answer for a file that is rewritten under the same name
        while Job.opened:
            Job.opened.pop().sites.unpersist()
