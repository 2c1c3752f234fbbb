"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words; its weight is its count in the text times the mean inverse document frequency of its words.
Samples of the weighted set are banded; documents that share a band are candidates, and a link needs a weighted Jaccard
similarity of ``THRESHOLD`` or more, computed from the whole texts.  Classes are the connected components of links.

Inside a band's bucket no pairs are formed: every member is compared with the smallest one.  Members that then are in
another component than their bucket's smallest one are compared first with a few members of the bucket, then with all
that an upper bound of the similarity doesn't rule out.  So no link inside a bucket is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from cladeframe.llm.common import map_slices, stored, utf8
from cladeframe.llm.components import components
from cladeframe.llm.words import BREAKS, LOWER, U, WORD_BASE, mix, run_starts, span, sums, words

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.9992.
BANDS, ROWS = 10, 3
#: Frequencies of all words are counted; weights of the commonest words, this many at most, are told to all tasks, in units of 1 / UNIT.
#: Those of rarer words stay in Spark and are joined to the texts that have them, so what tasks hold is bounded and each word has its own weight.
TOLD, UNIT = 1 << 18, 1024
#: Classes of frequencies for each doubling; the told words are whole classes.
FINE = 4
#: Members of a bucket that its unlinked members are compared with before all of them are.
FEW = 8
#: Random draws by the upper bits of a shingle's hash.
POOL = 1 << 16


class Counter:
    """Words of each text once, added up for a slice; the number of texts stands beside a null word."""

    def __call__(self, part: pa.RecordBatch) -> dict:
        w = words(*utf8(part.column("text")), BREAKS, LOWER)
        h, doc = w.hashes(), w.doc
        order = np.lexsort([doc, h])
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        word, n = np.unique(h[new], return_counts=True)
        return {"word": pa.array([None, *word.view(np.int64).tolist()], pa.int64()), "n": np.append(part.num_rows, n)}


@dataclass
class Weights:
    """Weight of each told word, by its hash in order, and the one of all others."""

    word: np.ndarray
    weight: np.ndarray
    rest: int

    def told(self, h: np.ndarray) -> np.ndarray:
        return self.word[np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)] == h if len(self.word) else np.zeros(len(h), bool)

    def of(self, h: np.ndarray, rare: pa.Array | None = None) -> np.ndarray:
        """Weights of words by their hashes; ``rare`` has lists of (word, weight) of words that aren't told."""
        h, back = np.unique(h, return_inverse=True)
        out = np.full(len(h), self.rest, np.int64)
        every = [(self.word, self.weight)]
        if rare is not None and len(flat := rare.flatten()):
            word, first = np.unique(np.asarray(flat.field("word")).view(U), return_index=True)
            every.append((word, np.asarray(flat.field("weight"))[first]))
        for word, weight in every:
            if len(word):
                at = np.minimum(np.searchsorted(word, h), len(word) - 1)
                out = np.where(word[at] == h, weight[at], out)
        return out[back]


def _weight(n, total: int, log, rounded):
    return rounded(UNIT * (1 + 0.5 * log((total + 1) / (n + 1)) / np.log(total + 2)))


def all_weights(docs: DataFrame, told: int = TOLD) -> tuple[Weights, DataFrame | None]:
    """Weights of words from 1 (in every text) to 1.5 (in none), in units; frequencies are counted over all texts.

    The table of words grows with the corpus and stays in Spark; to the driver come the sizes of classes of frequency and the
    words in more than one text of the highest classes that have ``told`` words together.  Other words in more than one text are
    the second result, (word, weight); ``rest`` is the weight of words in one text.
    """
    rows = map_slices(docs.select("text"), "text", "word bigint, n bigint", Counter).groupBy("word").agg(F.sum("n").alias("n"))
    rows = stored(rows, "frequencies")
    total = (rows.where("word IS NULL").first() or (None, 0))[1]
    many = rows.where("word IS NOT NULL AND n > 1").withColumn("class", F.floor(FINE * F.log2("n")).cast("int"))
    lowest, held, sizes = None, 0, many.groupBy("class").count().collect()
    for c, k in sorted(sizes, reverse=True):
        if held + k > told:
            break
        lowest, held = c, held + k
    common = many.where(F.lit(False) if lowest is None else F.col("class") >= lowest).select("word", "n").toPandas()
    word, n = common["word"].to_numpy(np.int64).view(U), common["n"].to_numpy(np.float64)
    weight = _weight(n, total, np.log, np.round).astype(np.int64)
    order = np.argsort(word)
    rare = None
    if held < sum(k for _, k in sizes):
        left = many if lowest is None else many.where(F.col("class") < lowest)
        rare = left.select("word", _weight(F.col("n"), total, F.log, F.rint).cast("bigint").alias("weight"))
    return Weights(word[order], weight[order], round(_weight(1, total, np.log, float))), rare


def inverse_frequencies(docs: DataFrame, told: int = TOLD) -> Weights:
    """The told words of ``all_weights`` alone, for uses that can't join: all others have the weight of the rarest of them."""
    w, rare = all_weights(docs, told)
    return Weights(w.word, w.weight, int(w.weight.max()) if rare is not None and len(w.word) else w.rest)


RARE = "array<struct<word:bigint,weight:bigint>>"


def with_rare(texts: DataFrame, idf: Broadcast, rare: DataFrame | None) -> DataFrame:
    """(d, text, rare): texts with the weights of their words that aren't told; null where there are none."""
    if rare is None:
        return texts.withColumn("rare", F.lit(None).cast(RARE))

    def make():
        def work(part: pa.RecordBatch) -> dict:
            w = words(*utf8(part.column("text")), BREAKS, LOWER)
            h = w.hashes()
            keep = np.flatnonzero(~idf.value.told(h))
            pairs = np.unique(np.rec.fromarrays([np.asarray(part.column("d"))[w.doc[keep]], h[keep].view(np.int64)], names="d,word"))
            return {"d": pairs["d"], "word": pairs["word"]}
        return work

    met = map_slices(texts.select("d", "text"), "text", "d bigint, word bigint", make).join(rare, "word")
    own = met.groupBy("d").agg(F.collect_set(F.struct("word", "weight")).alias("rare"))
    return stored(texts.hint("merge").join(own, "d", "left").select("d", "text", "rare"), "weighed_texts")


class Shingles:
    """Distinct shingles of each text, in order of text and hash, with integer weights."""

    def __init__(self, column: pa.Array, idf: Weights, rare: pa.Array | None = None):
        w = words(*utf8(column), BREAKS, LOWER)
        h = w.hashes()
        prefix = sums(h, WORD_BASE[0])
        weight = np.concatenate([[0], np.cumsum(idf.of(h, rare))])
        start = run_starts(w.first, SHINGLE)
        end = start + SHINGLE
        doc = np.searchsorted(w.first, start, "right") - 1
        n = w.counts
        short = np.flatnonzero((n > 0) & (n < SHINGLE))  # one shingle of all words
        start, end, doc = np.concatenate([start, w.first[short]]), np.concatenate([end, w.first[short + 1]]), np.concatenate([doc, short])
        g = span(prefix, start, end, WORD_BASE[0])
        mean = (weight[end] - weight[start]) // (end - start)
        order = np.lexsort([g, doc])
        g, doc, mean = g[order], doc[order], mean[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.count = np.diff(np.append(at, len(g)))
        self.hash, self.doc, self.weight = g[at], doc[at], mean[at] * self.count
        self.texts = len(n)


@lru_cache(1)
def pool() -> tuple[np.ndarray, ...]:
    """r, 1 / r, beta and log c of each draw: r and c from Gamma(2, 1), beta uniform."""
    rng = np.random.default_rng(20)
    shape = (POOL, BANDS * ROWS)
    gamma = lambda: -np.log((1 - rng.random(shape, np.float32)) * (1 - rng.random(shape, np.float32)))
    r, log_c = np.maximum(gamma(), 1e-6), np.log(np.maximum(gamma(), 1e-6))
    return r, 1 / r, rng.random(shape, np.float32), log_c


def samples(s: Shingles, chunk: int = 8192) -> np.ndarray:
    """One consistent sample per text and draw: a hash of the shingle chosen and of its level."""
    r, r_inverse, beta, log_c = pool()
    k = r.shape[1]
    least, where = np.full((s.texts, k), np.inf, np.float32), np.zeros((s.texts, k), np.int64)
    place = (s.hash >> U(48)).astype(np.int64)
    log_w = np.log(s.weight / UNIT).astype(np.float32)
    for a in range(0, len(place), chunk):
        p, doc = place[a : a + chunk], s.doc[a : a + chunk]
        t = np.floor(log_w[a : a + chunk, None] * r_inverse[p] + beta[p])
        value = log_c[p] - r[p] * (t - beta[p] + 1)
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        low = np.minimum.reduceat(value, begin, axis=0)
        hit = value == np.repeat(low, np.diff(np.append(begin, len(p))), axis=0)
        row = np.minimum.reduceat(np.where(hit, np.arange(a, a + len(p))[:, None], len(place)), begin, axis=0)
        d = doc[begin]
        better = low < least[d]
        least[d], where[d] = np.where(better, low, least[d]), np.where(better, row, where[d])
    if not len(place):
        return np.zeros((s.texts, k), U)
    p = place[where]
    level = np.floor(log_w[where] * r_inverse[p, np.arange(k)] + beta[p, np.arange(k)]).astype(np.int64)
    return mix(s.hash[where] ^ mix(level.view(U)))


def _signature(idf: Broadcast):
    def make():
        def work(part: pa.RecordBatch) -> dict:
            s = Shingles(part.column("text"), idf.value, part.column("rare"))
            out = samples(s).reshape(s.texts, BANDS, ROWS)
            key = np.broadcast_to(mix(np.arange(BANDS).astype(U)), (s.texts, BANDS))
            for i in range(ROWS):
                key = mix(key ^ out[:, :, i])
            n = np.bincount(s.doc, minlength=s.texts)
            edge = np.searchsorted(s.doc, np.arange(s.texts))
            prints = []
            for salt in (0, 0x5851F42D4C957F2D):
                total = np.concatenate([np.zeros(1, U), np.cumsum(mix(s.hash ^ U(salt)) * s.count.astype(U))])
                prints.append((total[edge + n] - total[edge]).view(np.int64))
            return {"d": part.column("d"), "p1": prints[0], "p2": prints[1], "shingles": n, "bands": list(key.view(np.int64))}
        return work
    return make


def _similarity(idf: Broadcast):
    def make():
        def work(part: pa.RecordBatch) -> dict:
            a, b = (Shingles(part.column(f"text_{x}"), idf.value, part.column(f"rare_{x}")) for x in "ab")
            doc, h, w = (np.concatenate(x) for x in ((a.doc, b.doc), (a.hash, b.hash), (a.weight, b.weight)))
            order = np.lexsort([h, doc])
            doc, h, w = doc[order], h[order], w[order]
            same = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
            both = np.bincount(doc[same], np.minimum(w[same], w[same + 1]), part.num_rows)
            total = np.bincount(doc, w, part.num_rows)
            return {"similarity": both / np.maximum(total - both, 1)}
        return work
    return make


def verified(pairs: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame:
    """(a, b, similarity) of pairs, from whole texts.  Texts are always shuffled, so that the plan is the same at every size."""
    first = pairs.hint("merge").join(texts.select(F.col("d").alias("b"), F.col("text").alias("text_b"), F.col("rare").alias("rare_b")), "b")
    both = first.hint("merge").join(texts.select(F.col("d").alias("a"), F.col("text").alias("text_a"), F.col("rare").alias("rare_a")), "a").select("a", "b", "text_a", "text_b", "rare_a", "rare_b")
    return map_slices(both, "text_a text_b", "a bigint, b bigint, similarity double", _similarity(idf))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, told: int = TOLD) -> DataFrame:
    """(key, class_id) for every row: the smallest key of its class.

    Texts with the same shingles, each as often, are one node (so copies are linked without a comparison).  A text without
    a word is a class of its own.  Rows that share a key are one node; a null key has a null class.  Other columns aren't returned; if
    the key's name is ``class_id``, the class is named ``class_id_``.
    """
    spark, named_ = docs.sparkSession, "class_id_" if key.lower() == "class_id" else "class_id"
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weights, rare = all_weights(texts, told)
    idf = spark.sparkContext.broadcast(weights)
    texts = with_rare(texts, idf, rare)
    sig = stored(map_slices(texts, "text", "d bigint, p1 bigint, p2 bigint, shingles bigint, bands array<bigint>", _signature(idf)), "signatures")
    nodes = stored(sig.where("shingles > 0").groupBy("p1", "p2").agg(F.min("d").alias("node")), "nodes")
    own = sig.join(nodes, ["p1", "p2"]).where(F.col("d") == F.col("node"))
    banded = stored(own.select("node", F.explode(F.array_distinct("bands")).alias("band")).distinct(), "bands")
    buckets = banded.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("band", "least")
    members = stored(banded.join(buckets, "band"), "members")
    # later steps read only texts that share a bucket
    texts = stored(texts.hint("merge").join(members.select(F.col("node").alias("d")).distinct(), "d"), "candidates")
    pairs = members.where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    known = stored(verified(stored(pairs, "pairs"), texts, idf), "verified")
    links = known.where(F.col("similarity") >= threshold).select("a", "b")
    found = stored(components(links), "components")
    open_ = unsettled(members, known, found, texts, idf, threshold)
    open_ = stored(open_.join(own.select("node", F.array_distinct("bands").alias("bands")).dropDuplicates(["node"]), "node"), "unsettled")
    for choose in (to_few, to_all):
        rest = stored(choose(placed(open_, found), known, threshold).join(known.select("a", "b"), ["a", "b"], "left_anti"), "rest")
        if rest.isEmpty():
            continue
        known = known.unionByName(stored(verified(rest, texts, idf), "verified"))
        links = known.where(F.col("similarity") >= threshold).select("a", "b")
        found = stored(components(links), "components")
    named = nodes.join(found, "node", "left")
    named = stored(named.select("p1", "p2", F.coalesce("component", "node").alias("class_id")), "classes")
    out = sig.where("shingles > 0").join(named, ["p1", "p2"]).select(F.col("d").alias(key), F.col("class_id").alias(named_))
    alone = sig.where("shingles = 0").select(F.col("d").alias(key), F.col("d").alias(named_))
    none = docs.where(F.col(key).isNull()).select(F.col(key).cast("bigint").alias(key), F.lit(None).cast("bigint").alias(named_))
    return out.unionByName(alone).unionByName(none)


def _weights(idf: Broadcast):
    def make():
        def work(part: pa.RecordBatch) -> dict:
            s = Shingles(part.column("text"), idf.value, part.column("rare"))
            return {"d": np.asarray(part.column("d"))[s.doc], "shingle": s.hash.view(np.int64), "weight": s.weight}
        return work
    return make


def placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with their component and ``main``, the component of their bucket's smallest member."""
    m = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.select(F.col("node").alias("least"), F.col("component").alias("main"))
    return m.join(least, "least", "left").withColumn("main", F.coalesce("main", "least"))


def unsettled(members: DataFrame, known: DataFrame, found: DataFrame, texts: DataFrame, idf: Broadcast, threshold: float) -> DataFrame:
    """Members of buckets with several components that may still be linked: (band, least, node, total, common, pivot, total_p).

    ``total`` is a text's weight, ``common`` that of its shingles that another of these texts has; ``pivot`` is the member most like
    the bucket's smallest one (of edits of one text, the least edited).
    """
    m = stored(placed(members, found), "placed")
    m = m.join(m.where("component <> main").select("band").distinct(), "band")
    m = m.join(known.select(F.col("a").alias("least"), F.col("b").alias("node"), "similarity"), ["least", "node"], "left")
    m = m.select("band", "node", "least", F.coalesce("similarity", F.lit(1.0)).alias("s"))
    m = stored(m, "mixed")
    rows = map_slices(texts.hint("merge").join(m.select(F.col("node").alias("d")).distinct(), "d").select("d", "text", "rare"), "text", "d bigint, shingle bigint, weight bigint", _weights(idf))
    by_shingle = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"), F.sum("weight").alias("weight"))
    lonely = by_shingle.where("n = 1").groupBy("d").agg(F.sum("weight").alias("lonely"))
    total = rows.groupBy("d").agg(F.sum("weight").alias("total"))
    weighed = total.join(lonely, "d", "left").select(F.col("d").alias("node"), F.col("total").cast("double"), (F.col("total") - F.coalesce("lonely", F.lit(0))).cast("double").alias("common"))
    m = stored(m.join(weighed.where(F.col("common") >= threshold * F.col("total")), "node"), "weighed")
    likeness = F.struct((F.col("node") != F.col("least")).alias("other"), F.col("s"), F.col("common") / F.col("total"), F.col("node"))
    pivots = m.groupBy("band").agg(F.max_by(F.struct("node", "total"), likeness).alias("p"))
    return m.drop("s").join(pivots.select("band", F.col("p.node").alias("pivot"), F.col("p.total").alias("total_p")), "band")


def _pair(u: str, v: str) -> list:
    return [F.least(u, v).alias("a"), F.greatest(u, v).alias("b")]


def to_few(m: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Each member with its bucket's pivot, and each outside the component of the bucket's smallest one with one member of each of
    ``FEW`` parts of that component, by hash.  What can be linked mostly is so here, by a number of pairs in proportion."""
    m = stored(m, "placed")
    inside = m.where("component = main").withColumn("h", F.xxhash64("node", "band"))
    few = inside.groupBy("band", F.pmod("h", F.lit(FEW))).agg(F.min_by("node", F.struct("h", "node")).alias("v")).select("band", "v")
    pairs = m.where("component <> main").join(few, "band").select(*_pair("node", "v"))
    return pairs.unionByName(m.where("node <> pivot").select(*_pair("node", "pivot"))).where("a <> b").distinct()


def to_all(m: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Each member outside the component of its bucket's smallest one with every other member that no bound rules out, at the
    first bucket they share.

    What two texts have in common lies in the pivot, where it weighs no more than what either shares with the pivot, or
    outside, where it weighs no more than what either shares there with any other text.
    """
    m = m.select("*", *_pair("node", "pivot")).join(known, ["a", "b"], "left")
    with_pivot = F.when(F.col("node") == F.col("pivot"), F.col("total")).otherwise(F.col("similarity") * (F.col("total") + F.col("total_p")) / (1 + F.col("similarity")))
    # shingles that no other text has may be in the pivot only if it is this text, so this is at least 0 but for rounding
    m = stored(m.withColumn("inner", F.least(with_pivot, "common")).withColumn("outer", F.col("common") - F.col("inner")), "placed")
    side = lambda d, x: d.select("band", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "total", "inner", "outer", "bands")])
    pairs = side(m.where("component <> main"), "u").join(side(m, "v").join(m.select("band", "main").distinct(), "band"), "band")
    pairs = pairs.where("component_u <> component_v AND (component_v = main OR node_u < node_v)")
    both = F.least("inner_u", "inner_v") + F.least("outer_u", "outer_v") + 2
    pairs = pairs.where(both >= threshold * (F.col("total_u") + F.col("total_v") - both))
    return pairs.where(F.col("band") == F.array_min(F.array_intersect("bands_u", "bands_v"))).select(*_pair("node_u", "node_v")).distinct()
