"""Alphabets: which symbol stands for which set of states."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# State symbols and ambiguity codes of the supported data types.
DNA_STATES = "ACGT"
# Code of every subset of ACGT, indexed by the bit mask (A=1, C=2, G=4, T=8).
DNA_BY_MASK = "-ACMGRSVTWYHKDBN"
AA_STATES = "ARNDCQEGHILKMFPSTWYV"
AA_AMBIGUOUS = {"B": "ND", "Z": "QE", "J": "IL"}
BIN_STATES = "01"
# Diploid genotype symbols: homozygous A C G T, then heterozygous AC AG AT CG CT GT.
GT_STATES = "ACGTMRWSYK"
MULTI_STATES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!\"#$%&'()*+,/:;<=>@[\\]^_{|}~"
DNA_GAPS = "-?NOX."
AA_GAPS = "-?X*."
BIN_GAPS = "-?."
GT_GAPS = "-?N."
MULTI_GAPS = "-?."


@dataclass(frozen=True)
class Alphabet:
    """Symbol -> bit mask over the states; gaps are compatible with every state."""

    states: str
    masks: dict[str, int] = field(hash=False)
    gaps: str = "-?"

    @property
    def size(self) -> int:
        return len(self.states)

    @property
    def full(self) -> int:
        return (1 << len(self.states)) - 1

    def symbols(self) -> str:
        return "".join(sorted(self.masks))

    def table(self) -> np.ndarray:
        """Byte -> mask lookup; 0 marks a symbol outside the alphabet."""
        lut = np.zeros(256, dtype=np.uint64)
        for ch, mask in self.masks.items():
            lut[ord(ch)] = mask
        return lut

    def code_of(self, mask: int) -> str | None:
        """Symbol of a state set: the first in ASCII order that means it."""
        hits = [c for c, m in self.masks.items() if m == mask]
        return min(hits) if hits else None


def build(states: str, gaps: str, ambiguous: dict[str, str] | None = None, fold_case: bool = True) -> Alphabet:
    masks = {c: 1 << i for i, c in enumerate(states)}
    for code, members in (ambiguous or {}).items():
        masks[code] = sum(masks[m] for m in members)
    full = (1 << len(states)) - 1
    for g in gaps:
        masks.setdefault(g, full)
    if fold_case:
        for c, m in list(masks.items()):
            masks.setdefault(c.lower(), m)
            masks.setdefault(c.upper(), m)
    return Alphabet(states, masks, gaps)


def dna() -> Alphabet:
    codes = {DNA_BY_MASK[m]: "".join(s for i, s in enumerate(DNA_STATES) if m >> i & 1) for m in range(1, 15)}
    a = build(DNA_STATES, DNA_GAPS, {c: s for c, s in codes.items() if len(s) > 1})
    a.masks.update({"U": 8, "u": 8})
    return a


def protein() -> Alphabet:
    return build(AA_STATES, AA_GAPS, AA_AMBIGUOUS)


def binary() -> Alphabet:
    return build(BIN_STATES, BIN_GAPS)


def genotype() -> Alphabet:
    return build(GT_STATES, GT_GAPS)


def multistate(n: int) -> Alphabet:
    if not 1 < n <= min(64, len(MULTI_STATES)):
        raise ValueError(f"unsupported number of states: {n}")
    return build(MULTI_STATES[:n], MULTI_GAPS, fold_case=n <= 36)


def state_mask(ch: Column, alphabet: Alphabet) -> Column:
    """Column expression: bit mask of one symbol, null if it is not in the alphabet."""
    pairs = [F.lit(x) for c, m in sorted(alphabet.masks.items()) for x in (c, int(m))]
    keys = F.array(*pairs[0::2])
    vals = F.array(*[v.cast("bigint") for v in pairs[1::2]])
    return F.element_at(F.map_from_arrays(keys, vals), ch)


def canonical_symbols(pattern: Column, alphabet: Alphabet) -> Column:
    """Rewrite every symbol to one representative of its state set.

    A single JVM ``translate``: columns that differ only in case or in the choice of
    synonymous codes then group together.
    """
    best: dict[int, str] = {}
    for c in sorted(alphabet.masks, key=lambda c: (c != c.upper(), c)):
        best.setdefault(alphabet.masks[c], c)
    src = [c for c in sorted(alphabet.masks) if best[alphabet.masks[c]] != c]
    dst = [best[alphabet.masks[c]] for c in src]
    return F.translate(pattern, "".join(src), "".join(dst)) if src else pattern
