"""Filter audit, centroid clustering and license scan against brute force and, where SQL says the same, SQL; odd rows for each."""

import collections
import hashlib
import itertools
import math
import random
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cladeframe.llm import centroids, filter_audit, licenses, queries
from cladeframe.llm.license_rules import REACH, RULES, Rule, anchored
from tests.llm.test_operators import ODD, empty, odd_docs
from tests.oracle import connect, norm


def test_sql(spark, sf):
    con = connect(sf)
    for name in ("op11_filter_audit", "op12_centroids"):
        got = queries.Q[name](spark, sf)
        cur = con.execute(queries.O[name])
        cols = [c[0] for c in cur.description]
        assert norm([tuple(r) for r in got.collect()], got.columns) == norm(cur.fetchall(), cols), name


# -- filter audit -------------------------------------------------------------------------------

def steps_by_hand(counts, order, names="ABCDE"):
    """(filter, kept, removed) of each step by going through all masks."""
    left = dict(counts)
    for f in order:
        gone = {m for m in left if m >> names.index(f) & 1}
        removed = [sum(left[m][i] for m in gone) for i in range(3)]
        left = {m: w for m, w in left.items() if m not in gone}
        yield f, [sum(w[i] for w in left.values()) for i in range(3)], removed


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(0, 15), st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3))), st.lists(st.integers(0, 2), max_size=12))
def test_diagram(counts, places):
    d = filter_audit.Diagram(counts, 4)
    for p in [None, *places]:
        if p is not None:
            d.swap(p)
        got = [(f, list(k), list(r)) for f, k, r in d.steps()] if any(any(w) for w in counts.values()) else None
        if got:
            order = ["ABCD"[f] for f in d.order]
            assert [("ABCD"[f], k, r) for f, k, r in got] == list(steps_by_hand(counts, order, "ABCD"))
    for n in range(1, 6):
        o = list(range(n))
        seen = [tuple(o)]
        for s in filter_audit.swaps(n):
            o[s], o[s + 1] = o[s + 1], o[s]
            seen.append(tuple(o))
        assert len(seen) == len(set(seen)) == math.factorial(n)


def test_audit(spark):
    words = lambda n, k: " ".join(f"w{i % k}" for i in range(n))
    texts = [words(60, 60), words(60, 10), words(49, 49), words(80, 80) + " $", "ABCDEF " * 20 + words(60, 60), None, "", words(60, 60), "\x0b".join(f"w{i}" for i in range(50)), "x " * 5000, "é" * 200, "日本 & " * 30]
    rng = random.Random(2)
    rows = [(i, texts[i % len(texts)], rng.choice(["s", "t", "", None])) for i in range(90)] + [(None, texts[0], "s"), (None, "own", "s"), (3, texts[3], "s"), (0, texts[0], "t"), (95, texts[3], "u")]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)] + [(0, 1, 0), (None, 1, 1), (3, 1, 1), (500, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit(1)).withColumn("words", F.lit("x"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.masks(docs), labels).collect()
    good, toxic = {d for d, q, _ in marks if q == 1}, {d for d, _, t in marks if t == 1}
    parts = collections.defaultdict(lambda: collections.defaultdict(lambda: (0, 0, 0)))
    for d, t, s in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        copies = [e for e, u, _ in rows if (u or "") == t and e is not None]
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(set(t) & set("#$%&*|")), d is not None and min(copies) < d]
        mask = sum(1 << k for k, f in enumerate(fails) if f)
        n, g, x = parts[s or ""][mask]
        parts[s or ""][mask] = (n + 1, g + (d in good and d is not None), x + (d in toxic and d is not None))
    want = {}
    for part, counts in parts.items():
        told = {o: list(steps_by_hand(counts, o)) for o in itertools.permutations("ABCDE")}
        for o, steps in told.items():
            for k, (f, kept, removed) in enumerate(steps, 1):
                b = 1 << "ABCDE".index(f)
                failing = sum(w[0] for m, w in counts.items() if m & b)
                shapley = sum(r[0] for s in told.values() for g, _, r in s if g == f)
                want[part, "".join(o), k] = (f, kept[0], removed[0], failing - removed[0], counts[b][0] if b in counts else 0, removed[1], removed[2], shapley)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want) == 600 * len(parts)
    assert filter_audit.audit(filter_audit.masks(docs.where("false")), labels).count() == 0
    assert filter_audit.audit(filter_audit.masks(docs), labels.where("false")).agg(F.sum("good_lost")).first()[0] == 0
    one = filter_audit.audit(filter_audit.masks(odd_docs(spark).withColumn("source", F.lit(None).cast("string"))), labels)
    assert one.count() == 600 and {(r.part, r.kept + r.removed) for r in one.where("step = 1").collect()} == {("", len(ODD) + 3)}


# -- centroids ----------------------------------------------------------------------------------

def clustered(rows, k=16, rounds=3, size=64):
    v = []
    for d, x in rows:
        if x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x):
            v.append((d, [max(-centroids.REACH, min(centroids.REACH, math.floor(c * 64))) for c in x]))
    head = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [x for _, x in head]

    def assign():
        out = []
        for d, x in v:
            far = [sum((a - b) ** 2 for a, b in zip(x, y)) for y in c]
            out.append((far.index(min(far)), min(far)))
        return out
    for _ in range(rounds):
        at = assign()
        for i in range(len(c)):
            own = [x for (_, x), (a, _) in zip(v, at) if a == i]
            if own:
                c[i] = [sum(z) // len(own) for z in zip(*own)]
    at = assign()
    sums = collections.Counter()
    for a, far in at:
        sums[a] += far
    cut = lambda n: min(n, centroids.LONGEST)
    return collections.Counter((d, a, far, cut(sums[a]), cut(sum(sums.values())), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (d, _), (a, far) in zip(v, at))


def test_centroids(spark):
    rng = random.Random(4)
    point = lambda: [float(rng.gauss(rng.choice([-1, 0, 1]), 0.3)) for _ in range(64)]
    rows = [(i, point()) for i in range(120)]
    rows += [(200, rows[0][1])] * 40 + [(7, rows[7][1])] * 2 + [(None, point()), (None, None), (301, None), (302, [0.0] * 63), (303, [float("nan")] + [0.0] * 63), (304, [float("-inf")] + [0.0] * 63), (305, [None] + [0.0] * 63), (306, [0.0] * 64), (307, [-0.0] * 64)]
    make = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("own")).withColumn("x", F.lit(1))
    got = centroids.cluster(make(rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == clustered(rows)
    few = rows[:5] + [(400, [1e300] * 64), (401, [-1e300] * 64), (402, [3e7] * 64)]
    assert collections.Counter(tuple(r) for r in centroids.cluster(make(few)).collect()) == clustered(few)
    assert centroids.cluster(make(rows[121:122]).where("false")).count() == 0
    same = [(1, [0.5] * 64)] * 30
    assert collections.Counter(tuple(r) for r in centroids.cluster(make(same)).collect()) == clustered(same)


# -- licenses -----------------------------------------------------------------------------------

def scanned(text, rules):
    """The row's results by rules tried at every place of every keyword, and each pair of detections compared."""
    t = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = []
    for i, word in enumerate(w):
        for k, r in enumerate(rules):
            if r.keyword == word:
                shown = " " + " ".join([*w[max(0, i - REACH) : i], "=" + word, *w[i + 1 : i + 1 + REACH]]) + " "
                if m := re.search(anchored(r), shown):
                    first = i - m[0].split("=")[0].count(" ")
                    found.append((first, first + m[0].count(" "), k))
    rank = lambda d: (rules[d[2]].level, d[0] - d[1], d[2])
    nested = lambda a, b: a[0] <= b[0] and b[1] <= a[1] or b[0] <= a[0] and a[1] <= b[1]
    kept = [d for d in found if not any(nested(d, e) and rank(e) < rank(d) for e in found)]
    base = [d for d in found if rules[d[2]].base]
    sure = min((rules[d[2]].level for d in found), default=None)
    names = lambda ds: ",".join(sorted({rules[d[2]].label for d in ds}))
    return (len(w), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), names(base), names([*base, *kept]), licenses.SURE[sure] if sure else 0.0)


LINES = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.", "cc-by cc_by CC BY", "general public license general public license",
         "SPDX-License-Identifier: LGPL-2.1-or-later", "Copyright (c) 2019, 2020 Someone. All Rights Reserved", "you may not use this file except in compliance with the License", "tous droits réservés", "Alle Rechte vorbehalten", "dual licensed: GPLv2 or later, MPL 2.0", "all rights all rights reserved", "CCBY cc by", "all right reserved", "Aİl rights reserved",
         "ſ K general  public\tLICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"]


def test_licenses(spark):
    rng = random.Random(5)
    vocabulary = sorted({x for line in LINES for x in line.split()} | {"und", "the", "日本", "naïve"})
    texts = [*ODD, *LINES, *[" ".join(rng.choice([*LINES, *vocabulary]) for _ in range(rng.randint(1, 12))) for _ in range(150)], "cc by " * 3000, "license " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, "cc by"), (3, "cc by"), (None, "cc by")], "doc_id long, text string").withColumn("row", F.lit("own")).withColumn("Labels", F.lit(1))
    got = licenses.scan(docs)
    assert got.columns == ["doc_id", "row", *licenses.RESULTS]
    short = [(i, t) for i, t in enumerate(texts) if len(t or "") < 10_000]
    rows = {r.doc_id: tuple(r)[2:] for r in got.where("doc_id <> 3").collect()}
    for i, t in short:
        if i != 3:
            assert rows[i] == scanned(t, RULES), t
    assert rows[len(texts) - 2][:6] == (6000, 3000, 0, 5998, "cc-by", "cc-by")
    assert got.where("doc_id = 3 OR doc_id IS NULL").where("n_base = 1").count() == 3 and got.count() == len(texts) + 3
    assert licenses.scan(empty(spark)).count() == 0 and licenses.scan(empty(spark).select("text")).columns == licenses.RESULTS


def test_rules():
    for r in RULES:
        p = anchored(r)
        assert "=" + r.keyword in p and re.compile(p)
        spare = re.sub(r"\([^)]*\)|\[[^\]]*\]", "x", r.pattern)
        assert len(spare.split()) <= REACH + 1 and "+" not in re.sub(r"\[\^ \]\+|\[0-9\]\+", "", r.pattern) and "*" not in r.pattern
    assert len(RULES) >= 300 and len(set(RULES)) == len(RULES)
    assert Rule("gpl", 3, "license", "general public license", True) in RULES
