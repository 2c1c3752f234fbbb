"""Command-line options: one dataclass, parsed with argparse and checked as a whole."""

from __future__ import annotations

import argparse
import json
import re
import time
from dataclasses import asdict, dataclass, field

from cladeframe.operators.checks import safety_checks

COMMANDS = ("help", "version", "check", "parse", "start", "evaluate", "loglh", "search", "search1", "bootstrap", "all", "support",
            "bsconverge", "bsmsa", "rfdist", "rf", "consense", "ancestral", "terrace")
NEED_MSA = ("evaluate", "loglh", "search", "search1", "bootstrap", "all", "terrace", "check", "parse", "start", "ancestral", "bsmsa")
NEED_TREE = ("evaluate", "loglh", "support", "terrace", "rfdist", "rf", "consense", "ancestral")


class OptionError(ValueError):
    pass


@dataclass
class Options:
    command: str = "search"
    msa: str = ""
    msa_format: str = "auto"
    data_type: str | None = None
    tree: str = ""
    constraint: str = ""
    model: str = "GTR"
    prefix: str = ""
    outgroup: list[str] = field(default_factory=list)
    redo: bool = False
    nofiles: bool = False
    log: str = "progress"
    precision: int = 6
    seed: int = 0
    pat_comp: bool = True
    prob_msa: bool = True
    brlen: str = "scaled"
    blmin: float = 1e-6
    blmax: float = 100.0
    blopt: str = "nr_fast"
    opt_model: bool = True
    opt_branches: bool = True
    lh_epsilon: float = 0.1
    spr_radius: int = 0
    spr_cutoff: float = 1.0
    start_trees: dict[str, int] = field(default_factory=dict)
    num_searches: int = 0
    bootstraps: int = 0
    bootstop: str = ""
    bs_trees_file: str = ""
    bs_cutoff: float = 0.03
    bs_interval: int = 50
    bs_permutations: int = 1000
    bs_metric: list[str] = field(default_factory=lambda: ["fbp"])
    consense: str = "MR"
    ancestral_file: str = ""
    terrace_max: int = 100
    threads: int = 0
    workers: int = 1
    simd: str = ""
    tip_inner: bool = False
    site_repeats: bool = True
    rate_scalers: bool | None = None
    extra: list[str] = field(default_factory=list)
    force: str | None = None

    def checks(self) -> set[str]:
        return safety_checks(self.force)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Options:
        return Options(**json.loads(text))


def _switch(text: str) -> bool:
    if text.lower() not in ("on", "off"):
        raise argparse.ArgumentTypeError(f"expected on or off, not {text}")
    return text.lower() == "on"


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise OptionError(message)


def _parser() -> argparse.ArgumentParser:
    p = _Parser(prog="cladeframe", allow_abbrev=False, add_help=False, description="Phylogenetic analysis of alignments and tree sets on Spark")
    cmd = p.add_argument_group("commands (default: search)")
    one = cmd.add_mutually_exclusive_group()
    for c in COMMANDS:
        optional = c in ("rfdist", "rf", "consense", "ancestral")
        if optional:
            one.add_argument(f"--{c}", nargs="?", const="", default=None)
        else:
            one.add_argument(f"--{c}", action="store_true", default=None)
    io = p.add_argument_group("input and output")
    for flag in ("tree", "msa", "msa-format", "data-type", "tree-constraint", "prefix", "log", "outgroup"):
        io.add_argument(f"--{flag}")
    io.add_argument("--redo", action="store_true")
    io.add_argument("--nofiles", action="store_true")
    io.add_argument("--precision", type=int)
    g = p.add_argument_group("general")
    for flag in ("seed", "threads", "workers"):
        g.add_argument(f"--{flag}", type=int)
    for flag in ("pat-comp", "tip-inner", "site-repeats", "rate-scalers"):
        g.add_argument(f"--{flag}", type=_switch)
    g.add_argument("--simd", choices=("none", "sse3", "avx", "avx2"), type=str.lower)
    g.add_argument("--force", nargs="?", const="all")
    m = p.add_argument_group("model")
    m.add_argument("--model")
    m.add_argument("--brlen", choices=("linked", "scaled", "unlinked"))
    m.add_argument("--blmin", type=float)
    m.add_argument("--blmax", type=float)
    m.add_argument("--blopt", choices=("nr_fast", "nr_safe", "nr_oldfast", "nr_oldsafe", "off"))
    for flag in ("opt-model", "opt-branches", "prob-msa"):
        m.add_argument(f"--{flag}", type=_switch)
    m.add_argument("--lh-epsilon", type=float)
    s = p.add_argument_group("search and bootstrap")
    s.add_argument("--spr-radius", type=int)
    s.add_argument("--spr-cutoff", type=lambda x: -1.0 if x.lower() == "off" else float(x))
    s.add_argument("--bs-trees")
    s.add_argument("--bs-cutoff", type=float)
    s.add_argument("--bs-metric")
    s.add_argument("--terrace-maxsize", type=int)
    s.add_argument("--extra")
    return p


def usage() -> str:
    return _parser().format_help()


def parse_start_trees(o: Options, text: str) -> None:
    """``rand{N}``, ``pars{N}`` or file names, comma-separated; N defaults to 10."""
    for item in re.findall(r"[^,{]+(?:\{[^}]*\})?", text):
        m = re.fullmatch(r"(rand|random|pars|parsimony)(?:\{(\d+)\})?", item)
        if m:
            kind = "random" if m.group(1).startswith("rand") else "parsimony"
            if kind not in o.start_trees or m.group(2):
                o.start_trees[kind] = int(m.group(2) or 10)
        else:
            o.tree = f"{o.tree},{item}" if o.tree else item
            o.start_trees["user"] = 1


def parse(argv: list[str]) -> Options:
    o = Options()
    if not argv:
        o.command = "help"
        return o
    a = vars(_parser().parse_args(argv))
    for c in COMMANDS:
        if a[c] is not None:
            o.command = c
            if c in ("rfdist", "rf") and a[c]:
                o.tree = a[c]
            elif c == "consense" and a[c]:
                o.consense = a[c].upper()
            elif c == "ancestral" and a[c]:
                o.msa = a[c]
    plain = {"msa": "msa", "data_type": "data_type", "tree_constraint": "constraint", "model": "model", "prefix": "prefix",
             "log": "log", "precision": "precision", "seed": "seed", "pat_comp": "pat_comp", "prob_msa": "prob_msa", "brlen": "brlen",
             "blmin": "blmin", "blmax": "blmax", "blopt": "blopt", "opt_model": "opt_model", "opt_branches": "opt_branches",
             "lh_epsilon": "lh_epsilon", "spr_radius": "spr_radius", "spr_cutoff": "spr_cutoff", "threads": "threads",
             "workers": "workers", "simd": "simd", "tip_inner": "tip_inner", "site_repeats": "site_repeats",
             "rate_scalers": "rate_scalers", "terrace_maxsize": "terrace_max", "force": "force", "redo": "redo", "nofiles": "nofiles"}
    for src, dst in plain.items():
        if a[src] is not None:
            setattr(o, dst, a[src])
    if a["msa_format"]:
        o.msa_format = a["msa_format"].lower()
    if o.data_type:
        o.data_type = {"DNA": "DNA", "AA": "AA", "BIN": "BIN", "BINARY": "BIN", "GT": "GT", "MULTI": "MULTI", "AUTO": None}.get(o.data_type.upper(), "?")
        if o.data_type == "?":
            raise OptionError(f"unknown data type: {a['data_type']}")
    if a["seed"] is None:
        o.seed = int(time.time())
    o.outgroup = [x for x in (a["outgroup"] or "").split(",") if x]
    o.extra = [x for x in (a["extra"] or "").split(",") if x]
    if a["tree"]:
        parse_start_trees(o, a["tree"])
    if a["bs_cutoff"] is not None:
        o.bs_cutoff = a["bs_cutoff"]
    if a["bs_metric"]:
        o.bs_metric = [{"tbe-naive": "tbe", "tbe-nature": "tbe"}.get(x.lower(), x.lower()) for x in a["bs_metric"].split(",")]
        if set(o.bs_metric) - {"fbp", "tbe"}:
            raise OptionError(f"unknown support metric: {a['bs_metric']}")
    if a["prob_msa"]:  # asked for; by default columns stay together until there are probabilities
        o.pat_comp = False
    _bootstrap_count(o, a["bs_trees"])
    _aliases(o)
    _consistency(o)
    return o


def _bootstrap_count(o: Options, text: str | None) -> None:
    m = re.fullmatch(r"auto(MRE|MR|FC)?(?:\{(\d+)\})?", text or "", re.IGNORECASE)
    if m:
        o.bootstop, o.bootstraps = f"auto{(m.group(1) or 'MRE').upper()}", int(m.group(2) or 1000)
    elif text and text.isdigit():
        o.bootstraps = int(text)
    elif text:
        o.bs_trees_file = text
    if o.command in ("bootstrap", "all") and not o.bootstraps:
        if o.bs_trees_file:
            raise OptionError(f"invalid number of replicates: {o.bs_trees_file}")
        o.bootstraps = 1000 if o.command == "all" else 100
        o.bootstop = "autoMRE" if o.command == "all" else ""


def _aliases(o: Options) -> None:
    if o.command == "loglh":
        o.opt_model = o.opt_branches = False
        o.nofiles = True
    if o.blopt == "off":
        o.opt_branches = False
    if o.command == "rf":
        o.nofiles = True
    if o.command == "search1":
        o.start_trees = o.start_trees or {"random": 1}
    if o.command == "bsconverge" and not o.bootstop:
        o.bootstop = "autoMRE"
    if o.command in ("support", "rfdist", "rf", "consense") and not o.prefix:
        o.prefix = o.tree.split(",")[0]
    if o.command == "bsconverge" and not o.prefix:
        o.prefix = o.bs_trees_file


def _consistency(o: Options) -> None:
    c = o.command
    if c in NEED_MSA and not o.msa:
        raise OptionError("an alignment is required: --msa FILE")
    if c in NEED_TREE and not o.tree:
        raise OptionError("a Newick file is required: --tree FILE")
    if c == "start" and "user" in o.start_trees:
        raise OptionError("start generates trees; a user tree makes no sense here")
    if c in ("support", "bsconverge") and not o.bs_trees_file:
        raise OptionError("replicate trees are required: --bs-trees FILE")
    if c == "bsmsa" and not o.bootstraps:
        raise OptionError("the number of replicate alignments is required: --bs-trees N")
    if o.bootstraps and c not in ("bsmsa", "bootstrap", "all"):
        raise OptionError("--bs-trees N given, but this command does no bootstrapping")
    if o.lh_epsilon <= 0 or o.blmin <= 0 or o.blmax <= o.blmin:
        raise OptionError("epsilon and branch-length limits must be positive and ordered")
    if o.constraint and "parsimony" in o.start_trees:
        raise OptionError("parsimony starting trees cannot follow a constraint; use random ones")
    if c in ("search", "search1", "all", "evaluate", "loglh", "start", "ancestral"):
        if not o.start_trees:
            o.start_trees = {"random": 20} if o.constraint else {"random": 10, "parsimony": 10}
        o.num_searches = sum(o.start_trees.values())
    if o.bootstop in ("autoMR", "autoFC"):
        raise OptionError(f"{o.bootstop} is not supported; use autoMRE")
    if o.bootstop and o.bs_interval < 2 * o.workers:
        raise OptionError("the convergence interval must be at least twice the number of workers")
    o.checks()
