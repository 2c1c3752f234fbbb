"""Operators on small tables against brute force, libraries, round trips and held-out labels; odd rows for each."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cladeframe.llm import bpe, digest_index, htmltext, langid, packing, repeats, toxicity, urlmodel, vptree, weighted_minhash
from cladeframe.llm.common import scratch
from cladeframe.llm.components import components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "x " * 3, "ß\u00e9 \u65e5\u672c <|endoftext|> it's", "word " * 30_000, "l" * 20_000]


def odd_docs(spark, extra="score"):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no key here at all"), (3, "a"), (3, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn(extra, F.lit("own"))


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, kept string")


# -- language -----------------------------------------------------------------------------------

def test_language(spark):
    rng = random.Random(1)
    text = {"xx": "abcde", "yy": "fghij"}
    rows = [(i, prose(rng, 60, text[k]), k) for i in range(60) for k in text]
    train, held = rows[:80], rows[80:]
    net = langid.train(langid.samples(spark.createDataFrame(train, "doc_id long, text string, lang string"), "text", "lang", "doc_id"), steps=60)
    got = langid.predict(spark.createDataFrame(held, "doc_id long, text string, lang string"), net).collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in got)
    odd = langid.predict(odd_docs(spark), net).collect()
    assert len(odd) == len(ODD) + 3 and [r.lang_pred for r in odd][:3] == ["und"] * 3 and all(0 <= r.score <= 1 for r in odd)


def test_language_gradient():
    rng = np.random.default_rng(0)
    p = {}
    for k in (0, 1):
        p |= {f"x{k}": rng.normal(size=(6, 256)) * 0.3, f"u{k}": rng.normal(size=(6, 2)), f"c{k}": rng.normal(size=(2, 1))}
    p |= {"v": rng.normal(size=(3, 4)), "b": np.zeros((3, 1))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    steps, target = rng.integers(0, 5, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    mask = np.ones((7, 4), np.float32)
    _, g = langid._gradients(p, steps, target, mask)
    for name in ("u0", "u1", "c0", "v", "x1"):
        at = (0, 1) if name != "c0" else (1, 0)
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        slope = (langid._gradients(up, steps, target, mask)[0] - langid._gradients(down, steps, target, mask)[0]) / 2e-2
        assert abs(slope - g[name][at]) < 2e-3


def test_language_without_labels(spark):
    e = empty(spark)
    net = langid.train(langid.samples(e, "text", "lang", "doc_id"))
    assert {r.lang_pred for r in langid.predict(odd_docs(spark), net).collect()} == {"und"}
    assert langid.predict(e, net).count() == 0


# -- tokens --------------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aA thein's\n\t.,1 é\u0301İſΣ\u00a0\x1c<|>")), st.characters(codec="utf-8")), max_size=120))
def test_tokens_equal_library(text):
    t = library(BYTE)
    own = bpe.codec(BYTE)
    ids = own.encode([text])
    want = t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids[0], "<u4").tolist() == want
    assert own.decode(ids) == [t.decode(want, skip_special_tokens=False)]
    raw = np.frombuffer(text.encode(), np.uint8)
    units = packing.units(WORD, 1)
    want = library(WORD).encode(text, add_special_tokens=False).ids + [1]
    assert units.ids(raw, np.array([0, len(raw)]))[0].tolist() == want == units.long(raw)[0].tolist()


_known = {}


def library(path):
    return _known.setdefault(path, Tokenizer.from_file(path))


def test_round_trip(spark):
    got = bpe.round_trip(odd_docs(spark, "ids"), BYTE).collect()
    want = [t or "" for t in ODD] + ["no key here at all", "a", "a"]
    assert [r.decoded for r in got] == want
    assert [list(r.ids) for r in got] == [library(BYTE).encode(t, add_special_tokens=False).ids for t in want]
    assert bpe.round_trip(empty(spark), BYTE).count() == 0


def test_packing(spark):
    pieces = packing.pack(odd_docs(spark).coalesce(1), WORD, 64).collect()
    rows, by = [(i, t or "") for i, t in enumerate(ODD)] + [(None, "no key here at all"), (3, "a"), (3, "a")], collections.defaultdict(list)
    stream = []
    for _, t in rows:
        stream += library(WORD).encode(t, add_special_tokens=False).ids + [1]
    for p in pieces:
        by[p.sequence_id].append(p)
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        assert ids.tolist() == stream[p.sequence_id * 64 + p.offset :][: p.length]
    for s in by.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    assert sum(p.length for p in pieces) == len(stream) and len(by) == -(-len(stream) // 64)
    seq = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(packing.pack(odd_docs(spark).coalesce(1), WORD, 64)).collect()}
    assert sum((seq[k] for k in sorted(seq)), []) == stream
    assert packing.pack(empty(spark), WORD, 64).count() == 0


# -- copies ---------------------------------------------------------------------------------------

def test_exact(spark):
    rows = [(5, "a  b", 1), (2, "a\tb", 2), (9, None, 3), (8, "", 4), (None, "c", 5), (None, "c", 6), (7, "d", 7), (7, "d", 8), (1, "e", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    path = scratch(spark, "index")
    index = digest_index.DigestIndex(spark, path, 4)
    got = digest_index.deduplicate(docs, index).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for norm, keep, size in (("a b", 2, 2), ("", 8, 2), ("c", None, 2), ("d", 7, 2), ("e", 1, 1)):
        g = by[hashlib.sha256(norm.encode()).hexdigest()]
        assert len(g) == size and {r.group_size for r in g} == {size} and {r.keep_id for r in g} == {keep} and sum(r.kept for r in g) == 1
    index.close()
    again = digest_index.DigestIndex(spark, path, 16)
    assert again.buckets == 4
    more = digest_index.deduplicate(spark.createDataFrame([(0, "e"), (3, "f")], "doc_id long, text string"), again).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in more} == {(0, 1, False), (3, 3, True)}
    assert again.table().count() == 6
    assert digest_index.deduplicate(empty(spark), again).count() == 0
    again.close()


def plain_repeats(rows, n):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone[i : i + n] = [True] * n
            seen.setdefault(k, d)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_repeats(spark):
    rng = random.Random(3)
    shared = [prose(rng, rng.randint(18, 60)) for _ in range(6)]
    rows = []
    for d in range(120):
        parts = [prose(rng, rng.randint(0, 30)), rng.choice(shared), prose(rng, rng.randint(0, 5)), rng.choice(shared)[: rng.randint(40, 300)]]
        rows.append((d, "\n ".join(parts)))
    rows += [(200, None), (201, ""), (202, "ab " * 100), (203, rows[4][1]), (204, "cd " * 21)]
    got = repeats.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)), 20).collect()
    want = plain_repeats(rows, 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    assert all(sum(x.words for x in r.removed) == r.n_removed and all(x.words >= 20 for x in r.removed) for r in got)
    assert repeats.deduplicate(odd_docs(spark), 20).count() == len(ODD) + 3
    assert repeats.deduplicate(empty(spark), 20).count() == 0


def similarity(a, b):
    def shingles(t):
        w = re.sub(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", " ", t).lower().split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows, origin = [], []
    for g in range(25):
        base = prose(rng, 120).split()
        for v in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 2) if v else 0):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((len(rows), (", " if v % 2 else " ").join(w)))
            origin.append(g)
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One, two!"), (None, "one two")]
    got = weighted_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {r.doc_id: r.class_id for r in got}
    assert len(got) == len(rows) and of[900] == 900 and of[901] == 901 and of[902] == of[903] == 902 and of[None] is None
    for i in range(len(origin)):
        for j in range(i):
            if origin[i] != origin[j]:
                assert of[i] != of[j]
            elif similarity(rows[i][1], rows[j][1]) >= 0.87:
                assert of[i] == of[j]
    assert all(c is None or c <= d for d, c in of.items())
    assert weighted_minhash.classes(empty(spark)).count() == 0
    assert weighted_minhash.classes(odd_docs(spark)).count() == len(ODD) + 3


def test_weighted_samples_estimate_similarity():
    rng = random.Random(8)
    idf = weighted_minhash.Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), weighted_minhash.UNIT)
    a = prose(rng, 3000).split()
    b = a[:2500] + prose(rng, 500).split()
    s = weighted_minhash.samples(weighted_minhash.Shingles(pa.array([" ".join(a), " ".join(b)]), idf))
    assert abs((s[0] == s[1]).mean() - similarity(" ".join(a), " ".join(b))) < 0.25


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


# -- neighbours -----------------------------------------------------------------------------------

def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(1500, 8)), 1)
    x[100:400] = x[100]  # a common vector
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [None] + [1.0] * 7), (2004, [1.0, 2.0]), (2005, [1e200] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in vptree.nearest(v.where("vec_id % 50 = 0 OR vec_id = 2004"), vptree.index(v, 5), 5).collect():
        got[r.query_id].append(r)
    full = np.array([*x, [1e200] * 8])
    ids = np.array([*range(1500), 2005])
    unit = full / np.abs(full).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert 2004 not in got and len(got) == 30
    for q in got:
        c = np.round(unit @ unit[q], 12)
        want = [int(ids[i]) for i in np.lexsort([ids, -c]) if ids[i] != q][:5]
        rows = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and np.allclose([r.score for r in rows], [c[list(ids).index(w)] for w in want], atol=1e-9)
    e = v.where("false")
    assert vptree.nearest(v.limit(3), vptree.index(e, 5)).count() == 0 and vptree.nearest(e, vptree.index(v, 5)).count() == 0


@pytest.mark.parametrize("shard", [8192, 40])
def test_neighbours_of_repeated_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(vptree, "SHARD", shard)
    monkeypatch.setattr(vptree, "LEAF", 16)
    rng = np.random.default_rng(8)
    rows = [(i, np.round(rng.normal(size=4), 2)) for i in range(120)]
    rows += [(1000, rows[0][1] * 1.01)] * 6 + [(5, rows[5][1])] * 9  # copies of a neighbour, and of a query
    rows += [(i, rows[7][1]) for i in range(200, 220) for _ in range(8)]  # many ids, one vector, each repeated
    rows += [(9, rows[9][1] + 0.001 * j) for j in range(12)] + [(300, rows[11][1] * j) for j in range(1, 9)] + [(301, rows[11][1] + 0.001 * j) for j in range(9)]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, embedding array<double>")
    asked = [0, 5, 7, 9, 11, 210, 300, 1000]
    got = collections.defaultdict(list)
    for r in vptree.nearest(v.where(F.col("vec_id").isin(asked)), vptree.index(v, 5), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for q in asked:
        best = {}
        for i, x in rows:
            if i != q:
                best[i] = max([best.get(i, -1.0), *(round(cosine(x, y), 12) for j, y in rows if j == q)])
        want = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:5]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5] and len({n for _, n, _ in got[q]}) == 5
        assert np.allclose([s for _, _, s in got[q]], [s for _, s in want], atol=1e-9)
        assert all(abs(best[n] - s) < 1e-9 for _, n, s in got[q])


def test_neighbours_recall(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    trees = vptree.index(v, 5)
    exact, pruned = ({(r.query_id, r.vec_id) for r in vptree.nearest(v.where("vec_id % 10 = 0"), trees, 5, f).collect()} for f in (1.0, 1.1))
    assert len(exact & pruned) >= 0.9 * len(exact)


# -- toxicity, pages, URLs -------------------------------------------------------------------------

def test_toxicity(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        w = prose(rng, 40).split()
        if i % 6 == 0:
            for k in range(3):
                w[rng.randrange(40)] = rng.choice(["zzbad", "zzworse", "zzworst"]) + rng.choice("klm")
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    model = toxicity.train(spark.createDataFrame(rows[:900], "doc_id long, text string, toxic int"))
    got = toxicity.score(spark.createDataFrame(rows[900:], "doc_id long, text string, toxic int"), model).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd_docs(spark), model).count() == len(ODD) + 3
    none = toxicity.train(empty(spark).withColumn("toxic", F.lit(1)))
    assert {r.score for r in toxicity.score(odd_docs(spark), none).collect()} == {0.0}


def test_isotonic():
    low, value = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0, 1, 0, 1, 1, 1]))
    assert value.tolist() == [0, 0.5, 1] and low.tolist() == [1, 2, 4]


PAGES = [
    ("<p>a<p>b <b>c</b>\n d<br>e", "a\n\nb c d\ne"),
    ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>t", "- x\n- y\n  3. z\n\nt"),
    ("<table><tr><th>n<th>long<tr><td>1000<td>v</table>", "n     long\n1000  v"),
    ("<div hidden>no</div><span style='display:none'>no</span><script>if (a<b) {}</script><p>yes", "yes"),
    ("<table>stray<tr><td>c</table>", "stray\nc"), ("a &lt;b&gt; &amp; c", "a <b> & c"), ("<pre>\n x\n  y</pre>", " x\n  y"),
    ("<!-- <p>no --><title>no</title>yes</p></div>", "yes"), ("", ""), (None, ""), ("<a href='", ""), ("<textarea> t <b></textarea>", "t <b>"), ("<blockquote>q", "> q"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_page(page, text):
    assert htmltext.render(page) == text


WHOLE_PAGES = [
    ("<!doctype html><html><head><title>T</title><p>Hello", "Hello"), ("<head><meta charset=x>\n Hello <b>you", "Hello you"),
    ("<head><style>a</style><link rel=x><script>b</script><div>c</div>", "c"), ("<head><title>T</title></head><body>a", "a"), ("<p>a<head><p>b", "a\n\nb"),
    ("<html><head>&nbsp;a", "\xa0a"), ("<head></p></div><title>no</title></body>a", "a"),
    ("a<svg viewBox='0 0 1 1'><title>no</title><defs><text>no</text></defs>no<path d='M0'/><text>b <tspan>c</tspan></text><text display='none'>no</text></svg>d", "a\nb c\nd"),
    ("<svg><style/><text><![CDATA[a>b]]></text><foreignObject><p>c</p></foreignObject></svg>d", "a>b\n\nc\n\nd"),
    ("x <math><mi>y</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> z", "x y=1 z"), ("<svg><path><p>a", "a"), ("<a href=/><svg/>b</a>c", "bc"),
    ("<svg>" + "<path/>" * 400 + "<text>a</text></svg>b", "a\nb"),
    ("<div hidden>" + "<div>" * 250 + "no" + "</div>" * 250 + "no</div>yes", "yes"), ("<div>" * 250 + "a<div hidden>no<div>no</div>no</div>b" + "</div>" * 250 + "c", "a\nb\nc"),
    ("<section hidden>" + "<b>" * 199 + "<section>no</section>no" + "</b>" * 199 + "no</section>yes", "yes"), ("<i>" * 250 + "a<br>b<script>no</script>c", "a\nbc"),
]


@pytest.mark.parametrize("page,text", WHOLE_PAGES)
def test_whole_page(page, text):
    assert htmltext.render(page) == text


def test_deep_page_in_linear_time():
    assert htmltext.render("<p><button>" + "<div>" * 100_000 + "x" + "</div>" * 100_000 + "y") == "x\ny"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<div>", "</div>", "<br>", "w1 ", "w2 ", "w3 "]), max_size=40))
def test_no_text_is_lost(parts):
    got = re.findall(r"w\d", htmltext.render("".join(parts)))
    assert sorted(got) == sorted(p.strip() for p in parts if p[0] == "w")


def test_pages(spark):
    pages = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)] + [(99, "<div>" * 3000 + "x" * 100_000)], "page_id long, html string").withColumn("text", F.lit("own"))
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)} | {99: "x" * 100_000}
    assert htmltext.extract(pages.where("false")).count() == 0


def plain_urls(urls):
    rules = sorted(((r.name, r.host, r.path, r.verdict) for r in urlmodel.RULES), key=lambda r: -len(r[0]))

    def cut(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule(h, p):
        return next(((n, v) for n, host, path, v in rules if (h == host or h.endswith("." + host)) and p.startswith(path)), None)

    def code(c):
        c = c.lower()
        return ord(c) - 97 if "a" <= c <= "z" else 26 if c.isascii() and c.isdigit() else {".": 27, "/": 28, "-": 29}.get(c, 30 if c < "\x80" else 31)

    def grams(u):
        s = [31, 31] + [code(c) for c in u or ""]
        return [tuple(s[i : i + 3]) for i in range(len(s) - 2)]
    decided = [(grams(u), rule(*cut(u))[1] == "allow") for u in urls if rule(*cut(u))]
    p = []
    for side in (True, False):
        n = [collections.Counter() for _ in range(3)]
        for g, a in decided:
            for x in g if a == side else []:
                for k in range(3):
                    n[k][x[2 - k :]] += 1

        def prob(x, n=n):
            q = 1 / 32
            for k in range(3):
                same = [v for y, v in n[k].items() if y[:-1] == x[2 - k : 2]]
                if same:
                    q = (n[k][x[2 - k :]] + len(same) * q) / (sum(same) + len(same))
            return q
        p.append(prob)
    ratio = lambda g: sum(np.log(p[0](x)) - np.log(p[1](x)) for x in g) / len(g) if g else 0.0
    return [(*cut(u), (rule(*cut(u)) or (None,))[0], ratio(grams(u))) for u in urls], [(ratio(g), a) for g, a in decided]


def test_urls(spark):
    rng = random.Random(6)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'M.', ''])}{prose(rng, 1, 'abc' if k != 'net' else 'xyz')}.example.{k}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(1, 99)}{rng.choice(['', '?q=1', '#t'])}" for k in ("com", "net", "org") for _ in range(25)]
    urls += [None, "", "no-scheme", "://", "http://com", "http://com/", "http://xcom/", "http://a.NET/es/é?x", "http://b//c://d/e"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])]
    got = urlmodel.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("own")).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))).collect()
    assert len(got) == len(rows)
    want, decided = plain_urls(urls + [urls[0]])
    passed = {}
    for r in got:
        host, path, rule, ratio = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and abs(r.ratio - ratio) < 1e-9
        if rule:
            assert r.verdict == next(x.verdict for x in urlmodel.RULES if x.name == rule)
        elif urls[r.page_id]:
            passed.setdefault(r.verdict, []).append(r.ratio)
        else:
            assert r.verdict == "block"
    assert min(passed["allow"]) >= max(passed["block"])
    loss = lambda t: np.mean([x < t for x, a in decided if a]) + np.mean([x >= t for x, a in decided if not a])
    between = np.linspace(max(passed["block"]) + 1e-9, min(passed["allow"]), 200)
    assert min(map(loss, between)) <= min(loss(t) for t in np.arange(-2, 2, 0.01)) + 0.02
    assert urlmodel.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert {r.verdict for r in urlmodel.judge(spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")).collect()} == {"allow"}


def test_word_weights(spark):
    texts = ["a b b c", "A c d", "a c", "a", None, "日本 a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    seen = collections.Counter(w for t in texts if t for w in set(t.lower().split()))
    want = lambda n: round(1024 * (1 + 0.5 * np.log(7 / (n + 1)) / np.log(8)))
    h = words_of("a c b d 日本 never")
    full = weighted_minhash.inverse_frequencies(docs)
    assert list(full.of(h)) == [want(seen[w]) if seen[w] > 1 else want(1) for w in ("a", "c", "b", "d", "日本", "never")]
    one = weighted_minhash.inverse_frequencies(docs, told=1)
    assert set(one.of(h)) == {want(5)} and one.word.size == 1  # all others have the weight of the rarest one told
    assert weighted_minhash.inverse_frequencies(docs, told=0).word.size == 0
    none = weighted_minhash.inverse_frequencies(docs.where("false"))
    assert none.of(h).shape == (6,)
    assert weighted_minhash.classes(docs.withColumn("class_id", F.lit(1)), key="class_id").columns == ["class_id", "class_id_"]


def words_of(text):
    return weighted_minhash.words(*weighted_minhash.utf8(pa.array([text])), weighted_minhash.BREAKS, weighted_minhash.LOWER).hashes()


def test_urls_in_real_characters(spark):
    rng = random.Random(9)
    rules = [urlmodel.Rule("allow", "a.org", "/"), urlmodel.Rule("block", "b.org", "/")]
    ends = {"a": ["id=1357", "é%20", "Ab_c", "日本"], "b": ["id=2468", "è%2F", "aB=c", "中国"]}
    urls = [f"http://{side}.org/{rng.choice('xyz')}{rng.choice('xyz')}?{rng.choice(ends[side])}" for side in "ab" for _ in range(60)]
    asked = {f"http://c.org/{x}?{e}": "allow" if side == "a" else "block" for side in "ab" for e in ends[side] for x in ("xy", "zz")}
    urls += [*asked, "http://d.org/\U0001f600", ""]
    got = urlmodel.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, order=5, folded=False).collect()
    assert len(got) == len(urls)
    assert {r.url: r.verdict for r in got if r.url in asked} == asked
    code = lambda u: [tuple(("\uffff" * 5 + u)[i : i + 6]) for i in range(len(u))]
    uniform = 1 / len({c for u in urls for c in u})
    n = {s: [collections.Counter(g[5 - k :] for u in urls if u.startswith(f"http://{s}.org/") for g in code(u)) for k in range(6)] for s in "ab"}

    def prob(g, s):
        q = uniform
        for k in range(6):
            same = [v for y, v in n[s][k].items() if y[:-1] == g[5 - k : 5]]
            if same:
                q = (n[s][k][g[5 - k :]] + len(same) * q) / (sum(same) + len(same))
        return q
    for r in got:
        want = np.mean([np.log(prob(g, "a")) - np.log(prob(g, "b")) for g in code(r.url)]) if r.url else 0.0
        assert abs(r.ratio - want) < 1e-9


def test_only_common_grams_are_told(spark, monkeypatch):
    """Files of a few bytes a row would let Spark tell all grams and places to the tasks, by way of the driver."""
    rng = random.Random(10)
    urls = [f"http://{side}.org/{rng.randint(1, 9999)}" for side in "abc" for _ in range(40)] + [None, "http://a.org/1", "http://a.org/1"]
    plans, kept = [], urlmodel.stored

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(urlmodel, "stored", noted)
    rules = [urlmodel.Rule("allow", "a.org", "/"), urlmodel.Rule("block", "b.org", "/")]
    out = urlmodel.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, order=5, folded=False)
    assert {(r.page_id, r.verdict) for r in out.where("url LIKE 'http://b%'").collect()} == {(i, "block") for i in range(40, 80)}
    plans.append(("verdicts", out._jdf.queryExecution().executedPlan().toString()))
    told = collections.Counter({name: 0 for name, _ in plans})
    for name, plan in plans:
        told[name] += plan.count("BroadcastExchange")
    assert told == {"urls": 0, "grams": 0, "urlmodel": 0, "ratios": 2, "verdicts": 0}  # the common ones, and which those are
    assert sum(plan.count("SortMergeJoin") for _, plan in plans if "SortMergeJoin" in plan) >= 13


def test_repeats_without_keys(spark):
    rng = random.Random(12)
    shared = prose(rng, 30)
    texts = [prose(rng, 15) + " " + shared, shared + " " + prose(rng, 15), prose(rng, 10) + " " + shared, shared]
    rows = [(4, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3])]
    got = repeats.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 20, with_text=True).collect()
    removed = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got)
    assert removed == sorted([(4, 45, 0), (0, 45, 30), (0, 40, 30), (0, 30, 30), (0, 30, 30)])


@pytest.mark.parametrize("page, text", [
    ('<div style="backface-visibility:hidden">shown</div>', "shown"), ('<p style="-webkit-backface-visibility: hidden; --nodisplay:none">a', "a"),
    ('<p style="display:none; display:block">a', "a"), ('<p style="display:none!important; display:block">a', ""), ('<p style="background:url(x;display:none);color:red">a', "a"),
    ("<p style=\"content:';display:none'\">a", "a"), ('<p style="DISPLAY : None ;">a', ""), ('<p style="display:/* ; */none">a', ""),
    ('<div style="visibility:hidden">a<p style="visibility:visible">b<span>c</span></p>d</div>e', "bc\n\ne"), ('<div style="visibility:hidden"><ul><li>a<li style="visibility:visible">b</ul></div>', "- b"),
    ('<div style="display:none">a<p style="visibility:visible">b</div>c', "c"), ('<p hidden="until-found">a</p>b', "b"), ('<div style="visibility:hidden"><hr><textarea>a</textarea></div>b', "b"),
    ("<dialog>a</dialog>b<dialog open>c</dialog>", "b\nc"), ("<details>x<summary>a</summary>b<p>c<details open><summary>d</summary>e</details></details>f", "a\nf"),
    ("<details open><summary>a</summary>b</details>c", "a\nb\nc"), ("<details><p>x</p><summary>a</summary><summary>b</summary></details>", "a"),
    ("<template><template>a</template>b</template>c", "c"), ("<template>a<template>b</template>c", ""), ("a<template></template>b", "ab"),
    ("<table><tr><td rowspan=2>A<td>1<tr><td>2</table>", "A  1\n   2"), ("<table><tr><td>a<td rowspan=0>b<tr><td>c<td>d<tbody><tr><td>e<td>f</table>", "a  b\nc     d\ne  f"),
    ("<table><tr><td rowspan=2 colspan=2>A<td>1<tr><td>2<tr><td>x<td>y<td>z</table>", "A     1\n      2\nx  y  z"), ("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本  x\nabc   y"),
])
def test_hidden_and_spanned(page, text):
    assert htmltext.render(page) == text


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_visible_words_against_a_plain_walk(seed):
    """Random well-formed pages; a plain recursion over the same tree says which words a browser shows, in order."""
    rng, n, want = random.Random(seed), [0], []
    hide = [("", {}), (" hidden", {"gone": True}), (' style="display:none"', {"gone": True}), (' style="visibility:hidden"', {"see": False}), (' style="color:red; visibility: visible"', {"see": True}), (' style="x-display:none"', {})]

    def build(depth, gone, see, where):
        out = []
        for _ in range(rng.randint(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                n[0] += 1
                out.append(f" w{n[0]} ")
                if not gone and see:
                    want.append(f"w{n[0]}")
                continue
            tag = rng.choice(["div", "span", "section", "ul", "blockquote", "details", "dialog", "template", "table", "b"])
            text, how = rng.choice(hide) if rng.random() < 0.5 else hide[0]
            g, s = gone or how.get("gone", False), how.get("see", see)
            if tag == "ul":
                inner = "".join(f"<li>{build(depth - 1, g, s, tag)}</li>" for _ in range(2))
            elif tag == "table":
                inner = f"<tr><td>{build(depth - 1, g, s, tag)}</td></tr>"
            elif tag == "details":
                shut = rng.random() < 0.5
                text += "" if shut else " open"
                inner = f"<summary>{build(0, g, s, tag)}</summary>{build(depth - 1, g or shut, s, tag)}"
            else:
                if tag == "dialog":
                    shut = rng.random() < 0.5
                    text += "" if shut else " open"
                    g |= shut
                inner = build(depth - 1, g or tag == "template", s, tag)
            out.append(f"<{tag}{text}>{inner}</{tag}>")
        return "".join(out)
    page = build(4, False, True, "")
    assert re.findall(r"w\d+", htmltext.render(page)) == want, page


def test_words_that_are_not_told_have_their_own_weights(spark):
    from cladeframe.llm import weighted_minhash as M
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{i}" for i in range(300)])
    texts = [" ".join(rng.choice(vocabulary, 40, p=np.arange(300, 0, -1) / 45150)) for _ in range(60)]
    texts += [t.replace(" w1", " x1", 1) for t in texts[:20]] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "d bigint, text string").selectExpr("d", "coalesce(text, '') AS text")
    full, none = M.all_weights(docs)
    assert none is None
    column = pa.array([t or "" for t in texts])
    want = M.Shingles(column, full)
    for told in (0, 40):
        few, rare = M.all_weights(docs, told)
        assert few.word.size <= told and rare is not None
        rows = M.with_rare(docs, spark.sparkContext.broadcast(few), rare).orderBy("d").toArrow()
        got = M.Shingles(rows["text"].combine_chunks(), few, rows["rare"].combine_chunks())
        for name in ("hash", "doc", "weight"):
            assert np.array_equal(getattr(got, name), getattr(want, name))
    both = [sorted(map(tuple, M.classes(docs, "text", "d", told=t).collect())) for t in (M.TOLD, 0)]
    assert both[0] == both[1]
