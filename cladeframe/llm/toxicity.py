"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of learnt lexicons (whole words and word beginnings), how near second-person words stand to
their hits, capitals, punctuation and obfuscation.  All are array operations on the bytes of many texts at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cladeframe.llm.common import map_slices, stored, utf8, without
from cladeframe.llm.words import BREAKS, BYTE_BASE, LOWER, U, Words, span, sums, words

#: Words of address in the four languages.
YOU = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie tú ti usted ustedes vosotros os".split()
#: Lexicon kinds: whole words, and words by their first 4, 5 and 6 bytes.
KINDS = (0, 4, 5, 6)
#: Letters that stand for others in obfuscated words.
LEET = LOWER.copy()
LEET[[ord(c) for c in "01345@$7!"]] = [ord(c) for c in "oieasasti"]
LEET_BREAKS = BREAKS.copy()
LEET_BREAKS[[ord(c) for c in "@$!"]] = False
NAMES = ["log_words", *[f"{n}_{k}" for k in ("word", "head4", "head5", "head6", "leet") for n in ("share", "hits")], "near_you", "capitals", "capital_words", "exclaims", "marks", "digits_inside", "single_letters", "triples"]


@dataclass
class Model:
    """Lexicons (sorted hashes by kind), trees (feature, cut, left, right, value arrays), first score and calibration steps."""

    lexicons: dict[int, np.ndarray] = field(default_factory=dict)
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    start: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    base: float = 0.0


def keys(w: Words) -> dict[int, np.ndarray]:
    """The hash of each word by lexicon kind; 0 where a word is too short."""
    return {k: w.heads(k) if k else w.hashes() for k in KINDS}


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span(sums(data.astype(U) + U(1), BYTE_BASE[0]), np.array([0]), np.array([len(data)]), BYTE_BASE[0])[0])


def _in(values: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Membership; a table of 16-bit remainders settles most values at once."""
    if not len(lexicon):
        return np.zeros(len(values), bool)
    table = np.zeros(1 << 16, bool)
    table[(lexicon & U(0xFFFF)).astype(np.int64)] = True
    out = table[(values & U(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    near = np.minimum(np.searchsorted(lexicon, values[at]), len(lexicon) - 1)
    out[at] = lexicon[near] == values[at]
    return out


def features(data: np.ndarray, off: np.ndarray, lexicons: dict[int, np.ndarray]) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    docs = len(off) - 1
    w = words(data, off, BREAKS, LOWER)
    n, doc = np.maximum(w.counts, 1), w.doc
    per = lambda mask, of: np.bincount(of[mask], minlength=docs)
    hits = {k: _in(h, lexicons.get(k, np.zeros(0, U))) for k, h in keys(w).items()}
    columns = [np.log1p(w.counts)]
    leet = words(data, off, LEET_BREAKS, LEET)
    counted = [per(hits[k], doc) for k in KINDS] + [per(_in(leet.hashes(), lexicons.get(0, np.zeros(0, U))), leet.doc)]
    for c in counted:
        columns += [c / n, np.log1p(c)]
    you = _in(w.hashes(), np.sort(np.array([_hash(x) for x in YOU], U)))
    any_hit = hits[0] | hits[5]
    around = np.concatenate([[0], np.cumsum(you)])
    at = np.flatnonzero(any_hit)
    low, high = np.maximum(at - 5, w.first[doc[at]]), np.minimum(at + 6, w.first[doc[at] + 1])
    close = np.zeros(len(any_hit), bool)
    close[at] = around[high] > around[low]
    columns.append(per(close, doc) / np.maximum(per(any_hit, doc), 1))
    byte_doc = np.repeat(np.arange(docs), np.diff(off))
    upper, letter = (data >= 65) & (data < 91), ((data | 32) >= 97) & ((data | 32) < 123)
    digit = (data >= 48) & (data < 58)
    columns.append(per(upper, byte_doc) / np.maximum(per(letter, byte_doc), 1))
    ups = np.concatenate([[0], np.cumsum(upper)])
    long = w.end - w.start
    columns.append(per((ups[w.end] - ups[w.start] == long) & (long > 1), doc) / n)
    columns.append(per((data == 33) | (data == 63), byte_doc) / n)
    columns.append(per(BREAKS[data] & (data > 32), byte_doc) / n)
    inside = np.zeros(len(data), bool)
    inside[1:-1] = (digit | (data == 64) | (data == 36) | (data == 42))[1:-1] & letter[:-2] & letter[2:]
    columns.append(per(inside, byte_doc) / n)
    columns.append(per(long == 1, doc) / n)
    triple = np.zeros(len(data), bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & letter[2:]
    columns.append(per(triple, byte_doc) / n)
    return np.column_stack(columns)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 10) -> tuple[list, float]:
    """Boosted trees for 0/1 labels with logistic loss; cuts at quantiles, leaves by one Newton step."""
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cuts = [np.unique(np.concatenate([q, [(c[c > 0].min() / 2)] if (c > 0).any() else []])) for q, c in zip(cuts, x.T)]
    code = np.column_stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)])  # code <= i means value <= cut i
    score, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        nodes, node = [], np.zeros(len(y), np.int64)

        def build(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, 0, 0, rate * gs / (hs + 1.0)])
            best = (1e-6, None, None)
            if level < depth and len(rows) >= 2 * least:
                for f in range(x.shape[1]):
                    m = len(cuts[f]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(code[rows, f], v, m))[:-1] for v in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
            if best[1] is not None:
                left = code[rows, best[1]] <= best[2]
                nodes[me][:2] = [best[1], float(cuts[best[1]][best[2]])]
                nodes[me][2], nodes[me][3] = build(rows[left], level + 1), build(rows[~left], level + 1)
            else:
                node[rows] = me
            return me

        build(np.arange(len(y)), 0)
        tree = tuple(np.array(c) for c in zip(*nodes))
        score += tree[4][node]
        out.append(tree)
    return out, start


def raw_score(x: np.ndarray, trees: list, start: float) -> np.ndarray:
    score = np.full(len(x), start)
    for feature, cut, left, right, value in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(len(feature)):
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            a = at[inner]
            at[inner] = np.where(x[inner, feature[a]] <= cut[a], left[a], right[a])
        score += value[at]
    return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing fit: lowest score of each block and its mean, by pooling adjacent violators."""
    u, inverse = np.unique(score, return_inverse=True)
    weight, total = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []
    for s, w, t in zip(u, weight, total):
        blocks.append([s, w, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, w1, t1 = blocks.pop()
            blocks[-1][1] += w1
            blocks[-1][2] += t1
    return np.array([b[0] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = 16_000, size: int = 1500, least: int = 3) -> Model:
    """Fit on a sample of about ``sample`` labelled rows, taken by a hash of the key.

    The lexicons hold, of each kind, the ``size`` entries that most favour the label, in at least ``least`` texts with it.  The trees
    must not see a text through a lexicon learnt from it, so each half of the sample gets its features by the other half's
    lexicons; two thirds of the rows then grow the trees, one third calibrates.  Scoring uses the lexicons of both halves
    together.  ``sample`` and ``size`` bound what reaches the driver, whatever the size of the table.
    """
    known = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(label) == 1).cast("int").alias("label"), F.xxhash64(key).alias("h"))
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        return Model(base=ones / max(n, 1))
    draw = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < min(1.0, sample / n)).withColumn("t", F.pmod(F.shiftright("h", 32), F.lit(6)).cast("int")).drop("h")
    chosen = stored(chosen, "labelled")

    def entries():
        def work(part: pa.RecordBatch) -> dict:
            w = words(*utf8(part.column("text")), BREAKS, LOWER)
            y, half = np.asarray(part.column("label")), np.asarray(part.column("t")) // 3
            rows = [[], [], [], [], []]
            for k, h in keys(w).items():
                there = h != 0
                pair = np.unique(np.column_stack([w.doc[there].astype(U), h[there]]), axis=0)
                doc = pair[:, 0].astype(int)
                for side in (0, 1):
                    mine = half[doc] == side
                    u, at = np.unique(pair[mine, 1], return_inverse=True)
                    for r, v in zip(rows, (np.full(len(u), k), np.full(len(u), side), u.view(np.int64), np.bincount(at, y[doc[mine]] == 1, len(u)), np.bincount(at, y[doc[mine]] == 0, len(u)))):
                        r.append(v.astype(np.int64))
            return dict(zip(("kind", "half", "entry", "ones", "zeros"), map(np.concatenate, rows)))
        return work

    counted = map_slices(chosen, "text", "kind bigint, half bigint, entry bigint, ones bigint, zeros bigint", entries)
    counts = stored(counted.groupBy("kind", "half", "entry").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")), "entries")
    of = {r.half: (r.ones, r.zeros) for r in chosen.groupBy(F.floor(F.col("t") / 3).alias("half")).agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros")).collect()}

    def best(sides: tuple[int, ...]) -> dict[int, np.ndarray]:
        total = [sum(of.get(s, (0, 0))[i] for s in sides) for i in (0, 1)]
        c = counts.where(F.col("half").isin(*sides)).groupBy("kind", "entry").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        favour = F.log((F.col("ones") + 0.5) / (total[0] + 1)) - F.log((F.col("zeros") + 0.5) / (total[1] + 1))
        order = Window.partitionBy("kind").orderBy(F.desc("favour"), F.desc("ones"), "entry")
        top = c.where(F.col("ones") >= least).withColumn("favour", favour).where(F.col("favour") > 1).withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
        got = top.select("kind", "entry").collect()
        return {k: np.sort(np.array([r.entry for r in got if r.kind == k], np.int64).view(U)) for k in KINDS}

    crossed, lexicons = {0: best((1,)), 1: best((0,))}, best((0, 1))

    def dense():
        def work(part: pa.RecordBatch) -> dict:
            half = np.asarray(part.column("t")) // 3
            data, off = utf8(part.column("text"))
            both = [features(data, off, crossed[s]) for s in (0, 1)]
            return {"x": list(np.where(half[:, None] == 0, *both))}
        return work

    rows = map_slices(chosen, "text", "x array<double>, label int, t int", dense).collect()
    rows.sort(key=lambda r: (r.t, r.label, r.x))
    x, y, t = np.array([r.x for r in rows]).reshape(len(rows), len(NAMES)), np.array([r.label for r in rows], float), np.array([r.t for r in rows])
    fit, rest = t % 3 < 2, t % 3 == 2
    if len(set(y[fit])) < 2 or len(set(y[rest])) < 2:
        fit = rest = np.ones(len(y), bool)
    if len(set(y)) < 2:
        return Model(lexicons, base=ones / n)
    trees, start = grow(x[fit], y[fit])
    return Model(lexicons, trees, start, isotonic(raw_score(x[rest], trees, start), y[rest]), ones / n)


def probability(x: np.ndarray, model: Model) -> np.ndarray:
    if not model.trees:
        return np.full(len(x), model.base)
    low, value = model.steps
    return value[np.maximum(np.searchsorted(low, raw_score(x, model.trees, model.start), "right") - 1, 0)]


def score(docs: DataFrame, model: Model, text: str = "text", cut: float = 0.3) -> DataFrame:
    """All columns, ``score`` and ``predicted``.

    Null and empty texts are scored by their features, which are zero.  Without labels the score is 0, with labels of one
    kind their mean.  Input columns with the names of results give way.
    """
    docs = without(docs, ["score", "predicted"])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        def work(part: pa.RecordBatch) -> dict:
            p = probability(features(*utf8(part.column(text)), model.lexicons), model)
            return {"score": p, "predicted": (p >= cut).astype(np.int32)}
        return work

    return map_slices(docs, text, schema, make)
