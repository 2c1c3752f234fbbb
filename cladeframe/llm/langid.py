"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time.  It labels every byte position with a probability for
each language; a document's probabilities are the means over all its positions.  Texts are read in windows (the state
starts at zero in each), so a text of any length takes bounded memory, and every byte is labelled once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cladeframe.llm.common import map_slices, utf8, without

UNDETERMINED = "und"
#: Window length in bytes when scoring, and how many windows run side by side.
WINDOW, LANES = 128, 2048


@dataclass
class Network:
    """Weights: x (3h x 256 inputs per byte), u (3h x h), c (h) for either direction; v (classes x 2h), b (classes)."""

    languages: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def hidden(self) -> int:
        return self.p["u0"].shape[1]


def _layer(x: np.ndarray, u: np.ndarray, c: np.ndarray, steps: np.ndarray, keep: bool):
    """States (t, h, lanes) of one direction over byte rows ``steps`` (t, lanes); with ``keep``, also the gates."""
    h = u.shape[1]
    t_len, lanes = steps.shape
    out = np.empty((t_len, h, lanes), np.float32)
    gates = np.empty((t_len, 4 * h, lanes), np.float32) if keep else None
    state = np.zeros((h, lanes), np.float32)
    own = np.empty((3 * h, lanes), np.float32)
    rec = np.empty((3 * h, lanes), np.float32)
    for t in range(t_len):
        np.take(x, steps[t], axis=1, out=own, mode="clip")
        np.matmul(u, state, out=rec)
        rz, n, m = own[: 2 * h], own[2 * h :], rec[2 * h :]
        rz += rec[: 2 * h]
        rz *= 0.5
        np.tanh(rz, out=rz)
        rz += 1
        rz *= 0.5
        m += c
        if keep:
            gates[t, 3 * h :] = m
        m *= rz[:h]
        n += m
        np.tanh(n, out=n)
        if keep:
            gates[t, : 3 * h] = own
        np.subtract(state, n, out=out[t])
        out[t] *= rz[h:]
        out[t] += n
        state = out[t]
    return out, gates


def _softmax(a: np.ndarray, axis: int) -> np.ndarray:
    a = np.exp(a - a.max(axis=axis, keepdims=True))
    return a / a.sum(axis=axis, keepdims=True)


def _gradients(p: dict, steps: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over marked positions, and its gradient, through all time steps of both directions."""
    t_len, lanes = steps.shape
    h = p["u0"].shape[1]
    runs = [_layer(p["x0"], p["u0"], p["c0"], steps, True), _layer(p["x1"], p["u1"], p["c1"], steps[::-1], True)]
    both = np.concatenate([runs[0][0], runs[1][0][::-1]], axis=1)
    prob = _softmax(p["v"] @ both + p["b"], 1)
    n = mask.sum()
    own = np.take_along_axis(prob, target[None, None, :].repeat(t_len, 0), 1)[:, 0]
    loss = float(-(np.log(own + 1e-9) * mask).sum() / n)
    d = prob * (mask / n)[:, None]
    np.put_along_axis(d, target[None, None, :].repeat(t_len, 0), np.take_along_axis(d, target[None, None, :].repeat(t_len, 0), 1) - (mask / n)[:, None], 1)
    g = {"v": np.einsum("tcl,thl->ch", d, both, optimize=True), "b": d.sum((0, 2))[:, None]}
    back = p["v"].T @ d
    for k, order in ((0, steps), (1, steps[::-1])):
        out, gates = runs[k]
        arriving = back[:, :h] if k == 0 else back[::-1, h:]
        u, du, dc = p[f"u{k}"], np.zeros_like(p[f"u{k}"]), np.zeros((h, 1), np.float32)
        dx = np.empty((t_len, 3 * h, lanes), np.float32)
        ds = np.zeros((h, lanes), np.float32)
        zero = np.zeros((h, lanes), np.float32)
        for t in range(t_len - 1, -1, -1):
            before = out[t - 1] if t else zero
            r, z, nn, m = (gates[t, i * h : (i + 1) * h] for i in range(4))
            dh = ds + arriving[t]
            dn = dh * (1 - z) * (1 - nn * nn)
            dz = dh * (before - nn) * z * (1 - z)
            dm = dn * r
            dr = dn * m * r * (1 - r)
            rec = np.concatenate([dr, dz, dm])
            du += rec @ before.T
            dc += dm.sum(1, keepdims=True)
            ds = dh * z + u.T @ rec
            dx[t, :h], dx[t, h : 2 * h], dx[t, 2 * h :] = dr, dz, dn
        flat, bytes_ = dx.transpose(1, 0, 2).reshape(3 * h, -1), order.reshape(-1)
        by = np.argsort(bytes_, kind="stable")
        values, at = np.unique(bytes_[by], return_index=True)
        gx = np.zeros((3 * h, 256), np.float32)
        gx[:, values] = np.add.reduceat(flat[:, by], at, axis=1)
        g |= {f"x{k}": gx, f"u{k}": du, f"c{k}": dc}
    return loss, g


def train(samples: list[tuple[bytes, str]], hidden: int = 12, steps: int = 240, batch: int = 192, seed: int = 7) -> Network:
    """Fit on (bytes, language) samples with Adam; the same samples give the same network."""
    languages = sorted({s[1] for s in samples})
    net = Network(languages)
    if not languages:
        return net
    rng = np.random.default_rng(seed)
    c = len(languages)
    samples = sorted(samples)
    width = max(1, max(len(s[0]) for s in samples))
    text = np.zeros((len(samples), width), np.uint8)
    mask = np.zeros((len(samples), width), np.float32)
    for i, (s, _) in enumerate(samples):
        text[i, : len(s)] = np.frombuffer(s, np.uint8)
        mask[i, : len(s)] = 1
    label = np.array([languages.index(s[1]) for s in samples])
    groups = [np.flatnonzero(label == k) for k in range(c)]
    init = lambda *shape, scale: rng.normal(scale=scale, size=shape).astype(np.float32)
    p = {}
    for k in (0, 1):
        p |= {f"x{k}": init(3 * hidden, 256, scale=0.3), f"u{k}": init(3 * hidden, hidden, scale=hidden**-0.5), f"c{k}": np.zeros((hidden, 1), np.float32)}
    p |= {"v": init(c, 2 * hidden, scale=hidden**-0.5), "b": np.zeros((c, 1), np.float32)}
    m1, m2 = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, batch // c)) for g in groups])
        _, g = _gradients(p, text[pick].T, label[pick], mask[pick].T)
        rate = 0.02 * (1 - (step - 1) / steps) + 1e-4
        for k in p:
            m1[k] += 0.1 * (g[k] - m1[k])
            m2[k] += 0.01 * (g[k] ** 2 - m2[k])
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    net.p = p
    return net


def pooled(net: Network, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean probability of each language over all bytes of each text; zeros for empty texts."""
    p, c = net.p, len(net.languages)
    size = np.diff(off)
    each = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), each)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    # the last window of a longer text ends with it; bytes that the window before it holds are not counted again
    begin = np.minimum(number * WINDOW, np.maximum(size[doc] - WINDOW, 0))
    skip = number * WINDOW - begin
    length = np.minimum(size[doc] - begin, WINDOW)
    total = np.zeros((len(size), c))
    for a in range(0, len(doc), LANES):
        w = slice(a, a + LANES)
        t = np.arange(WINDOW)[:, None]
        inside = t < length[w]
        steps = np.where(inside, data[np.minimum(off[doc[w]] + begin[w] + t, len(data) - 1)], 0)
        counted = (inside & (t >= skip[w])).astype(np.float32)
        forward, _ = _layer(p["x0"], p["u0"], p["c0"], steps, False)
        backward, _ = _layer(p["x1"], p["u1"], p["c1"], steps[::-1], False)
        h = net.hidden
        sums = np.zeros((c, steps.shape[1]))
        for i in range(WINDOW):
            z = p["v"][:, :h] @ forward[i]
            z += p["v"][:, h:] @ backward[WINDOW - 1 - i]
            z += p["b"]
            np.exp(np.clip(z, -60, 60, out=z), out=z)
            z *= counted[i] / z.sum(0)
            sums += z
        for k in range(c):
            total[:, k] += np.bincount(doc[w], sums[k], len(size))
    return total / np.maximum(size, 1)[:, None]


def samples(docs: DataFrame, text: str, lang: str, key: str, per_language: int = 300, windows: int = 8, chars: int = 64) -> list[tuple[bytes, str]]:
    """Training windows of about ``per_language`` labelled documents of each language, ``windows`` from each.

    These three bounds are the only limit on what training sees; documents are chosen by a hash of ``key``, windows by a
    hash of key and number, from the whole text.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, per_language / n)]) if counts else F.create_map()
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    at = lambda i: F.pmod(F.xxhash64(F.col(key), i), F.greatest(F.length(text) - chars + 1, F.lit(1))) + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(F.col(text), at(i).cast("int"), F.lit(chars)))
    rows = known.where(draw < F.element_at(share, F.col(lang))).select(F.explode(cut).alias("w"), F.col(lang).alias("l")).collect()
    return [(r.w.encode(), r.l) for r in rows if r.w]


def predict(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """All columns, ``lang_pred`` and ``score``.

    A null text, or one without a letter, gets ``und`` and 0; so does every text if nothing was learnt.  Equal texts get equal
    answers, and each input row gives one row; input columns named like the two results are replaced.
    """
    docs = docs if text in ("lang_pred", "score") else without(docs, ["lang_pred", "score"])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        def work(part: pa.RecordBatch) -> dict:
            column = part.column(text)
            letters = np.fromiter((t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()), bool, len(column))
            if not net.languages:
                return {"lang_pred": [UNDETERMINED] * len(column), "score": np.zeros(len(column))}
            prob = pooled(net, *utf8(column))
            best = prob.argmax(1)
            return {"lang_pred": [net.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)],
                    "score": np.where(letters, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)}
        return work

    return map_slices(docs, text, schema, make)


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key has none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of
