"""Registered queries over whole tables, the SQL beside one of them, and the pipeline against its stages' rules."""

import collections
import re

import corpus_pipeline
from cladeframe.llm import queries
from pyspark.sql import functions as F
from tests.oracle import connect, norm


def test_sql(spark, sf):
    got = queries.Q["op5_exact_dedup"](spark, sf)
    cur = connect(sf).execute(queries.O["op5_exact_dedup"])
    cols = [c[0] for c in cur.description]
    assert norm([tuple(r) for r in got.collect()], got.columns) == norm(cur.fetchall(), cols)


def test_rows(spark, sf):
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, table in (("op1_language", "documents"), ("op2_bpe", "documents"), ("op3_near_duplicates", "documents"), ("op6_toxicity", "documents"), ("op7_html", "pages"), ("op8_repeats", "documents"), ("op10_urls", "pages")):
        assert queries.Q[name](spark, sf).count() == n[table], name
    lang = queries.Q["op1_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, all_ = lang.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert right >= 0.95 * all_


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("digest", F.lit(1)).withColumn("Kept", F.lit("x")).withColumn("score", F.lit(2.0))
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**9).cast("long")))
    columns = docs.columns
    found = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        if name != "pack":
            assert out.columns == columns
        path = corpus_pipeline.scratch(spark, name)
        out.write.parquet(path)
        found[name] = docs = spark.read.parquet(path)
    text = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    exact, language, near, last = text(found["exact"]), text(found["language"]), text(found["near"]), text(found["substring"])
    first = {}
    for d, t in language:
        k = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        first[k] = min(d, first.get(k, d))
    assert collections.Counter(d for d, _ in exact) == collections.Counter(first.values())
    assert set(near) <= set(exact) and len(near) >= 0.8 * len(exact)
    seen = set()
    for d, t in sorted(last):
        w = t.split()
        assert w
        seen |= {tuple(w[i : i + 20]) for i in range(len(w) - 19)}
    assert {d for d, _ in last} <= {d for d, _ in near}
    pieces = found["pack"]
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {d for d, _ in last}
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, sf).count() == 0


def test_language_stage_without_labels(spark, sf):
    docs = spark.createDataFrame([(1, "clean text", None), (2, "12 34 !", None), (3, None, None), (4, "\u65e5\u672c", None), (5, "", None)], "doc_id long, text string, lang string")
    out = corpus_pipeline.language(spark, docs, sf)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 4]


def test_near_stage_keeps_texts_of_shared_ids(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, b), (5, a), (5, b + " more"), (9, c), (None, a + " x"), (None, "alone on this row " + c[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("own"))
    out = corpus_pipeline.near(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, b), (5, a), (9, c), (0, rows[5][1])])
