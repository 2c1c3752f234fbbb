"""Substitution model strings and the numbers behind them."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace

import numpy as np

from cladeframe.functions import states as st
from cladeframe.functions.ratehet import gamma_rates

# Named DNA models as (rate symmetry over AC AG AT CG CT GT, frequencies
# free), and their aliases.
DNA_MODELS = {
    "JC": ("000000", False), "F81": ("000000", True),
    "K80": ("010010", False), "HKY": ("010010", True),
    "TN93ef": ("010020", False), "TN93": ("010020", True),
    "K81": ("012210", False), "K81uf": ("012210", True),
    "TPM2": ("010212", False), "TPM2uf": ("010212", True),
    "TPM3": ("012012", False), "TPM3uf": ("012012", True),
    "TIM1": ("012230", False), "TIM1uf": ("012230", True),
    "TIM2": ("010232", False), "TIM2uf": ("010232", True),
    "TIM3": ("012032", False), "TIM3uf": ("012032", True),
    "TVMef": ("012314", False), "TVM": ("012314", True),
    "SYM": ("012345", False), "GTR": ("012345", True),
}
DNA_ALIASES = {"TrNef": "TN93ef", "TrN": "TN93", "TPM1": "K81", "TPM1uf": "K81uf"}
# Protein matrices with published constants, and mixtures with one matrix per category.
AA_MODELS = ("Blosum62", "cpREV", "Dayhoff", "DCMut", "DEN", "FLU", "HIVb", "HIVw", "JTT", "JTT-DCMut", "LG",
             "mtART", "mtMAM", "mtREV", "mtZOA", "PMB", "rtREV", "stmtREV", "VT", "WAG")
AA_MIXTURES = {"LG4M": "GAMMA", "LG4X": "FREE"}
PREFIX = {"DNA": "DNA", "AA": "PROT", "BIN": "BIN", "GT": "GT", "MULTI": "MULTI"}
MODES = ("freqs", "rates", "pinv", "alpha", "free_rates", "weights", "scaler")
FREE_RATE_BOUNDS = (0.001, 100.0)


@dataclass
class Model:
    name: str
    datatype: str
    alphabet: st.Alphabet
    symmetry: list[int]  # class of every state pair, 0-based and dense
    rates: np.ndarray    # one value per class
    freqs: np.ndarray
    mode: dict[str, str] = field(default_factory=lambda: dict.fromkeys(MODES, ""))
    ratehet: str = "FIXED"
    ncat: int = 1
    median: bool = False
    alpha: float = 1.0
    pinv: float = 0.0
    cat_rates: np.ndarray = field(default_factory=lambda: np.ones(1))
    cat_weights: np.ndarray = field(default_factory=lambda: np.ones(1))
    scaler: float = 1.0
    asc: str = ""
    asc_weights: tuple[float, ...] = ()
    custom: tuple[str, str, bool] = ("", "", True)  # states, gaps, case sensitive
    needs_matrix: bool = False

    @property
    def states(self) -> int:
        return self.alphabet.size

    @property
    def datatype_name(self) -> str:
        return f"MULTI{self.states}" if self.datatype == "MULTI" else self.datatype

    def free(self) -> list[str]:
        return [m for m in MODES if self.mode[m] == "ml"]

    def estimated(self, what: str) -> bool:
        return self.mode[what] in ("ml", "empirical")

    def free_params(self) -> int:
        k = self.states - 1 if self.estimated("freqs") else 0
        k += {"empirical": len(self.symmetry) - 1, "ml": len(self.rates) - 1}.get(self.mode["rates"], 0)
        k += self.estimated("pinv")
        if self.ncat > 1 and self.ratehet == "GAMMA":
            k += self.estimated("alpha")
        if self.ncat > 1 and self.ratehet == "FREE":
            k += (self.ncat - 1) * (self.estimated("free_rates") + self.estimated("weights"))
        return int(k)

    def pair_rates(self) -> np.ndarray:
        return self.rates[self.symmetry]

    def with_categories(self) -> Model:
        """Category rates recomputed from alpha (gamma) or rescaled to mean one (free rates)."""
        if self.ratehet == "GAMMA":
            return replace(self, cat_rates=gamma_rates(self.alpha, self.ncat, self.median),
                           cat_weights=np.full(self.ncat, 1 / self.ncat))
        if self.ratehet == "FREE":
            w = self.cat_weights / self.cat_weights.sum()
            return replace(self, cat_weights=w, cat_rates=self.cat_rates / (w * self.cat_rates).sum())
        return self

    def with_stats(self, base_freqs=None, inv_prop: float = 0.0, subst_rates=None) -> Model:
        """Empirical parameters taken from alignment statistics."""
        m = replace(self)
        if self.mode["freqs"] == "empirical" and base_freqs is not None:
            m.freqs = np.asarray(base_freqs, dtype=float)
        if self.mode["rates"] == "empirical" and subst_rates is not None:
            m.symmetry, m.rates = list(range(len(subst_rates))), np.asarray(subst_rates, dtype=float)
        if self.mode["pinv"] == "ml":
            m.pinv = inv_prop / 2
        elif self.mode["pinv"] == "empirical":
            m.pinv = inv_prop
        return m

    def text(self, params: bool = False, precision: int | None = None) -> str:
        """Canonical model string; ``params`` writes fitted values as user values."""
        mode = {k: ("user" if params and v == "ml" else v) for k, v in self.mode.items()}

        def num(x):
            return f"{x:.{precision}f}" if precision else f"{x:g}"

        def group(xs):
            return "{" + "/".join(num(x) for x in xs) + "}"

        out = self.name + (group(self.rates) if mode["rates"] == "user" else "")
        out += {"empirical": "+FC", "ml": "+FO", "equal": "+FE", "user": "+FU" + group(self.freqs)}.get(mode["freqs"], "")
        out += {"empirical": "+IC", "ml": "+I", "user": "+IU" + group([self.pinv])}.get(mode["pinv"], "")
        if self.ncat > 1 and self.ratehet == "GAMMA":
            out += f"+G{self.ncat}{'a' if self.median else 'm'}" + (group([self.alpha]) if mode["alpha"] == "user" else "")
        elif self.ncat > 1 and self.ratehet == "FREE":
            out += f"+R{self.ncat}"
            if mode["free_rates"] == "user":
                out += group(self.cat_rates) + group(self.cat_weights)
        out += {"ml": "+B", "user": "+BU" + group([self.scaler])}.get(mode["scaler"], "")
        if self.asc:
            out += f"+ASC_{self.asc}" + (group(self.asc_weights) if self.asc_weights else "")
        if self.custom[0]:
            out += f"+M{'' if self.custom[2] else 'i'}{{{self.custom[0]}}}" + (f"{{{self.custom[1]}}}" if self.custom[1] else "")
        return out


def _pairs(n: int) -> int:
    return n * (n - 1) // 2


def _dense(symbols) -> list[int]:
    """Renumber symmetry classes from 0 in the order of their symbols."""
    order = {c: i for i, c in enumerate(sorted(set(symbols)))}
    return [order[c] for c in symbols]


def genotype_symmetry() -> list[int]:
    """Single-allele changes take the class of the nucleotide pair, all double changes one more."""
    alleles = [(a, a) for a in range(4)] + [(a, b) for a in range(4) for b in range(a + 1, 4)]
    pair = {p: i for i, p in enumerate((a, b) for a in range(4) for b in range(a + 1, 4))}
    out = []
    for i, g in enumerate(alleles):
        for h in alleles[i + 1:]:
            hit = [tuple(sorted((g[x], h[y]))) for x in (0, 1) for y in (0, 1) if g[1 - x] == h[1 - y] and g[x] != h[y]]
            out.append(pair[hit[0]] if hit else 6)
    return out


def _base(name: str, datatype: str | None) -> Model:
    """The named model with its default modes: 'model' where constants exist, else 'ml'."""
    dna_name = DNA_ALIASES.get(name, name)
    mode = dict.fromkeys(MODES, "")
    multi = re.fullmatch(r"MULTI(\d+)_(MK|GTR|USER(\w+))", name)

    def make(dt, alphabet, sym, free_freqs, label=name, **kw):
        sym = list(sym)
        mode["freqs"] = "ml" if free_freqs else "model"
        mode["rates"] = "ml" if kw.pop("free_rates", len(set(sym)) > 1) else "model"
        n = alphabet.size
        return Model(label, dt, alphabet, sym, np.ones(max(sym) + 1), np.full(n, 1 / n), mode, **kw)

    if name in ("GTJC", "GTHKY4", "GTGTR4", "GTGTR") and datatype in (None, "GT"):
        g = genotype_symmetry()
        hky = [{0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}.get(c, 2) for c in g]
        sym = {"GTJC": [0] * 45, "GTHKY4": hky, "GTGTR4": g, "GTGTR": list(range(45))}[name]
        return make("GT", st.genotype(), sym, name != "GTJC")
    if multi:
        n = int(multi.group(1))
        a = st.multistate(n)
        kind = multi.group(2)
        if kind == "MK":
            return make("MULTI", a, [0] * _pairs(n), False)
        if kind == "GTR":
            return make("MULTI", a, range(_pairs(n)), True)
        if len(multi.group(3)) != _pairs(n):
            raise ValueError(f"rate symmetry of {name} needs {_pairs(n)} symbols")
        return make("MULTI", a, _dense(multi.group(3)), True)
    if name == "BIN" or datatype == "BIN":
        return make("BIN", st.binary(), [0], True, free_rates=True)
    if name in AA_MIXTURES and datatype in (None, "AA"):
        m = make("AA", st.protein(), [0] * 190, False, ratehet=AA_MIXTURES[name], ncat=4, needs_matrix=True)
        return m
    if name in AA_MODELS and datatype in (None, "AA"):
        return make("AA", st.protein(), range(190), False, free_rates=False, needs_matrix=True)
    if name == "PROTGTR":
        return make("AA", st.protein(), range(190), True)
    if dna_name in DNA_MODELS and datatype in (None, "DNA"):
        sym, ff = DNA_MODELS[dna_name]
        return make("DNA", st.dna(), _dense(sym), ff, label=dna_name)
    for dt, alphabet in (("DNA", st.dna()), ("AA", st.protein()), ("GT", st.genotype())):
        sym = name[len(PREFIX[dt]):]
        if name.startswith(PREFIX[dt]) and datatype in (None, dt):
            if len(sym) != _pairs(alphabet.size):
                break
            return make(dt, alphabet, _dense(sym), True)
    raise ValueError(f"invalid model name: {name}")


OPTION = re.compile(r"\+([A-Za-z_]+)(\d*)([am]?)((?:\{[^}]*\})*)")


def _numbers(text: str) -> list[float]:
    if os.path.isfile(text):
        with open(text) as f:
            return [float(x) for x in f.read().replace(",", " ").split()]
    return [float(x) for x in text.replace(",", "/").split("/")]


def parse_model(text: str = "GTR", datatype: str | None = None) -> Model:
    """Model string -> Model; raises ValueError for anything outside the grammar."""
    text = {"DNA": "GTR+G+F"}.get(text, text)
    head = re.match(r"[^+{\[]*", text).group(0)
    m = _base(head, datatype)
    rest = text[len(head):]
    user = re.match(r"\{([^}]*)\}", rest)
    if user:
        _user_rates(m, _numbers(user.group(1)))
        rest = rest[user.end():]
    pos = 0
    while pos < len(rest):
        o = OPTION.match(rest, pos)
        if not o:
            raise ValueError(f"wrong model specification: {text}")
        pos = o.end()
        _option(m, o.group(1), o.group(2), o.group(3), re.findall(r"\{([^}]*)\}", o.group(4)), text)
    return _finish(m)


def _user_rates(m: Model, values: list[float]) -> None:
    if m.datatype == "AA" and m.name in AA_MIXTURES:
        raise ValueError("user rates for multi-matrix models are not supported")
    n = m.states
    if len(values) == _pairs(n) + n:
        # PAML layout: lower triangle row by row, then frequencies
        low = np.zeros((n, n))
        low[np.tril_indices(n, -1)] = values[:_pairs(n)]
        m.symmetry = list(range(_pairs(n)))
        m.rates = low.T[np.triu_indices(n, 1)]
        m.freqs = np.array(values[_pairs(n):]) / sum(values[_pairs(n):])
        m.mode["freqs"] = m.mode["rates"] = "model"
        m.needs_matrix = False
        return
    if len(values) == _pairs(n) and len(values) != len(m.rates):
        m.symmetry, m.rates = list(range(_pairs(n))), np.array(values)
    elif len(values) == len(m.rates):
        m.rates = np.array(values)
    else:
        raise ValueError(f"{m.name} takes {len(m.rates)} rates, not {len(values)}")
    m.rates = m.rates / m.rates[m.symmetry[-1]]
    m.mode["rates"], m.needs_matrix = "user", False


def _user_freqs(m: Model, values: list[float]) -> None:
    if len(values) != m.states or any(v < 0 or v >= 1 for v in values):
        raise ValueError("frequencies must be numbers in [0, 1), one per state")
    m.freqs, m.mode["freqs"] = np.array(values), "user"


def _option(m: Model, flag: str, number: str, kind: str, groups: list[str], text: str) -> None:
    # the trailing a/m of "+G8a" and "+Ga"; letters are upper-cased as keywords are case-blind
    if flag[:1] in "gG" and len(flag) == 2 and flag[1] in "amAM":
        flag, kind = flag[0], flag[1].lower()
    key = flag.upper() if flag != "Mi" else "MI"
    nums = [_numbers(g) for g in groups] if key not in ("M", "MI") else []
    if key in ("F", "FC"):
        m.mode["freqs"] = "empirical"
    elif key == "FO":
        m.mode["freqs"] = "ml"
    elif key == "FE":
        m.mode["freqs"], m.freqs = "equal", np.full(m.states, 1 / m.states)
    elif key == "FU" and len(nums) == 1:
        _user_freqs(m, nums[0])
    elif key in ("I", "IO"):
        m.mode["pinv"] = "ml"
    elif key == "IC":
        m.mode["pinv"] = "empirical"
    elif key == "IU" and len(nums) == 1:
        m.mode["pinv"], m.pinv = "user", nums[0][0]
        if not 0 <= m.pinv < 1:
            raise ValueError("proportion of invariant columns must be in [0, 1)")
    elif key == "G":
        m.ratehet, m.ncat, m.median = "GAMMA", int(number or 4), kind == "a"
        if nums:
            m.alpha, m.mode["alpha"] = nums[0][0], "user"
    elif key == "R":
        m.ratehet, m.ncat = "FREE", int(number or (len(nums[0]) if nums else 4))
        m.cat_weights = np.full(m.ncat, 1 / m.ncat)
        if nums:
            if any(len(x) != m.ncat for x in nums):
                raise ValueError(f"{m.ncat} rates and weights expected: {text}")
            w = np.array(nums[1]) if len(nums) > 1 else np.ones(m.ncat)
            m.cat_weights = w / w.sum()
            m.cat_rates = np.array(nums[0]) / (m.cat_weights * nums[0]).sum()
            m.mode["free_rates"] = m.mode["weights"] = "user"
    elif key in ("B", "BO") and not nums:
        m.mode["scaler"] = "ml"
    elif key in ("B", "BU") and len(nums) == 1:
        m.mode["scaler"], m.scaler = "user", nums[0][0]
    elif key == "ASC_LEWIS" and not nums:
        m.asc = "LEWIS"
    elif key == "ASC_FELS" and len(nums) == 1:
        m.asc, m.asc_weights = "FELS", tuple(nums[0][:1])
    elif key == "ASC_STAM" and len(nums) == 1:
        if len(nums[0]) != m.states:
            raise ValueError("one ascertainment weight per state expected")
        m.asc, m.asc_weights = "STAM", tuple(nums[0])
    elif key in ("M", "MI") and groups:
        sensitive = key == "M"
        if len(groups[0]) != m.states:
            raise ValueError(f"{m.states} custom state symbols expected")
        gaps = groups[1] if len(groups) > 1 else ""
        m.alphabet = st.build(groups[0], gaps or "-?", fold_case=not sensitive)
        m.custom = (groups[0], gaps, sensitive)
    else:
        raise ValueError(f"wrong model specification: {text}")


def _finish(m: Model) -> Model:
    if m.ratehet == "GAMMA" and not m.mode["alpha"]:
        m.mode["alpha"] = "ml"
    if m.ratehet == "FREE":
        if not m.mode["free_rates"]:
            m.cat_rates = gamma_rates(1.0, m.ncat)
            m.cat_weights = np.full(m.ncat, 1 / m.ncat)
        for k in ("free_rates", "weights"):
            m.mode[k] = m.mode[k] or "ml"
    return m.with_categories()


def check_model(m: Model, parts: int = 1, linkage: str = "scaled") -> list[str]:
    """Combinations that cannot be computed, as messages."""
    bad = []
    if m.name in AA_MIXTURES and m.mode["freqs"] != "model":
        bad.append(f"{m.name} must keep its own frequencies")
    if m.name in AA_MIXTURES and (m.mode["freqs"] == "ml" or m.mode["rates"] == "ml"):
        bad.append("mixtures with ML frequencies or rates are not supported")
    if m.mode["freqs"] == "user" and abs(m.freqs.sum() - 1) > 0.01:
        bad.append(f"user frequencies of {m.name} sum to {m.freqs.sum():g}")
    if parts > 1 and m.ratehet == "FREE" and linkage == "linked":
        bad.append("free rates need scaled or unlinked branch lengths with several partitions")
    return bad


# -- substitution process ---------------------------------------------------------------

def eigen(m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Q = L diag(values) R, scaled to one expected change per unit of time."""
    if m.needs_matrix:
        raise NotImplementedError(f"the constants of {m.name} are not shipped: give them as {m.name}{{file}}")
    n = m.states
    pi = np.maximum(m.freqs, 1e-10)
    pi = pi / pi.sum()
    r = np.zeros((n, n))
    r[np.triu_indices(n, 1)] = m.pair_rates()
    r = r + r.T
    q = r * pi
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    q /= -(pi * np.diag(q)).sum()
    root = np.sqrt(pi)
    values, u = np.linalg.eigh(root[:, None] * q / root)
    return values, u / root[:, None], u.T * root


def transition(m: Model, t: float, derivative: int = 0) -> np.ndarray:
    """P(t) (or a derivative by t) per rate category: (categories, states, states).

    With invariant columns the category rates are divided by 1 - pinv, which keeps the mean
    rate over all columns at one.
    """
    values, left, right = eigen(m)
    speed = m.cat_rates * m.scaler / (1 - m.pinv)
    lam = values[None, :] * speed[:, None]
    e = np.exp(lam * t) * lam**derivative
    return np.einsum("ik,ck,kj->cij", left, e, right)


def total_free_params(models: list[Model], branches: int, linkage: str = "scaled") -> int:
    """Model parameters plus branch lengths (linked B, scaled B + P - 1, unlinked B * P)."""
    k = sum(m.free_params() for m in models)
    p = len(models)
    return k + {"linked": branches, "scaled": branches + p - 1, "unlinked": branches * p}[linkage if p > 1 else "linked"]
