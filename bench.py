"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Every query is run once untimed on the smallest scale (session and codegen warm-up) and
then timed to its last row on the benchmark scale.  ``throughput`` restates the times in
domain units.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cladeframe.functions.models import parse_model  # noqa: E402
from cladeframe.operators import likelihood as L, sites as S  # noqa: E402
from cladeframe.plans import inference as I, recipes as R  # noqa: E402
from cladeframe.plans.catalog import registry  # noqa: E402
from cladeframe.plans.catalog.likelihoods import LABELS, TREE  # noqa: E402
from cladeframe.session import get_spark  # noqa: E402

HEADLINE = [
    "compress_patterns", "compress_patterns_wide", "part_stats", "emp_base_freqs", "dup_seqs", "check_invalid_chars",
    "drop_gap_cols", "split_msa", "global_site", "view_uncompress", "bootstrap_weights", "bootstrap_multinomial",
    "splits_of_many_trees", "rf_pairwise", "rf_lowmem", "rf_unique", "support_fbp", "support_tbe", "consensus_mre_many",
    "bootstop_report", "loglh", "loglh_gamma_inv", "parsimony_score_wide", "ancestral_ml_state", "opt_brlen", "spr_round",
    "cmd_evaluate", "lb_benoit", "frac_histogram", "ic_scores",
]
WARM_DIR = "/root/testdata/sf0.001"


def timed(fn, spark, d) -> float:
    t = time.perf_counter()
    fn(spark, d).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def kernel_rates(spark, d) -> dict[str, float]:
    """Pattern-likelihoods per second of the packed scoring pass (wide alignment, Gamma model)."""
    m = parse_model("JC+G4{0.7}")
    names = [f"V{i}" for i in range(64)]
    p = S.compress_patterns(R.vector_sites(spark, d))
    text = "(" * 62 + "V0,V1)" + "".join(f",V{i})" for i in range(2, 62)) + ",V62,V63);"
    al = L.pack(p, names, m)
    topo = L.Topology.from_newick(text, names)
    cands = []
    for k in range(32):
        t = topo.copy()
        _, ln = t.rooted()
        cands.append(L.Candidate(t.set_lengths({v: 0.1 + 0.01 * k for v in ln}), {q: m for q in al.stats}))
    L.score(al, cands[:1])
    t0 = time.perf_counter()
    L.score(al, cands)
    wide = time.perf_counter() - t0
    n = sum(s["pattern_count"] for s in al.stats.values())
    al.close()
    al = L.pack(S.compress_patterns(R.line_sites(spark, d)), LABELS, m)
    s = I.Search(0, L.Topology.from_newick(TREE, LABELS), {q: m for q in al.stats})
    L.derivatives(al, [s.candidate()])
    t0 = time.perf_counter()
    L.derivatives(al, [s.candidate()])
    grad = time.perf_counter() - t0
    k = sum(x["pattern_count"] for x in al.stats.values())
    al.close()
    return {"pattern_node_likelihoods_per_sec": round(32 * n * 62 / wide), "pattern_branch_derivatives_per_sec": round(k * 11 / grad)}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark(os.environ.get("BENCH_CPUS", "8"), "bench")
    q = registry()[0]
    times: dict[str, float] = {}
    for name in HEADLINE:
        try:
            timed(q[name], spark, WARM_DIR)
            times[name] = round(timed(q[name], spark, d), 3)
        except Exception as e:  # noqa: BLE001 - a failing query must not hide the others
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
            times[name] = -1.0
        print(f"{name:26} {times[name]:8.2f}s", file=sys.stderr, flush=True)
    rates = kernel_rates(spark, d)
    columns = R.table(spark, d, "orders").count()
    trees = R.table(spark, d, "supplier").agg(F.count(F.lit(1))).first()[0]
    rates["columns_compressed_per_sec"] = round(columns / times["compress_patterns"])
    rates["tree_pairs_per_sec"] = round(trees * (trees - 1) / 2 / times["rf_pairwise"])
    rates["resampled_columns_per_sec"] = round(10 * columns / times["bootstrap_weights"])
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": round(sum(t for t in times.values() if t > 0), 3),
                      "unit": "sec", "queries": times, "throughput": rates, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


main()
