"""Registered queries of this subpackage with their production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeframe.llm import bpe, centroids, digest_index, filter_audit, htmltext, langid, licenses, packing, repeats, toxicity, urlmodel, vptree, weighted_minhash
from cladeframe.llm.common import scratch, table


def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.remainder("doc_id", 5) == 0, F.lit(False))
    net = langid.train(langid.samples(docs.where(langid.remainder("doc_id", 5) != 0), "text", "lang", "doc_id"))
    return langid.predict(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _digests(ids: bytes, back: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), derive=("n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests))


def op3_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return weighted_minhash.classes(docs).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vptree.nearest(vectors.where(F.col("vec_id") % 50 == 0), vptree.index(vectors, 5), 5)


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    index = digest_index.DigestIndex(spark, scratch(spark, "index"))
    out = digest_index.deduplicate(table(spark, sf, "documents").select("doc_id", "text"), index)
    index.close()
    return out


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.coalesce(langid.remainder("doc_id", 4) == 2, F.lit(False))
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.where(langid.remainder("doc_id", 4) != 2).join(labels, "doc_id"))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_html(spark: SparkSession, sf: str) -> DataFrame:
    return htmltext.extract(table(spark, sf, "pages").select("page_id", "html"))


def op8_repeats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return repeats.deduplicate(docs, 20).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    p = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1, with_ids=False)
    return p.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urlmodel.judge(table(spark, sf, "pages").select("page_id", "url"), order=5, folded=False).select("page_id", "host", "path", "rule", "verdict")


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = filter_audit.masks(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return filter_audit.audit(rows, table(spark, sf, "labels"))


def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster(table(spark, sf, "embeddings").select("vec_id", "embedding"))


def op13_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))


Q = {f.__name__: f for f in (op1_language, op2_bpe, op3_near_duplicates, op4_neighbours, op5_exact_dedup, op6_toxicity, op7_html, op8_repeats, op9_packing, op10_urls,
                              op11_filter_audit, op12_centroids, op13_licenses)}

def _clustering_sql() -> str:
    floor = "(s - ((s % n) + n) % n) // n"
    nearest = ("SELECT k, vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.k, vec_id, v.x, z.c, "
               "list_sum(list_transform(list_zip(v.x, z.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} z) GROUP BY k, vec_id, x")
    rounds = "".join(
        f"a{r} AS ({nearest.format(r=r)}), p{r} AS (SELECT c, j, count(*) AS n, sum(x[j])::BIGINT AS s FROM a{r}, range(1, 65) q(j) GROUP BY c, j), "
        f"m{r} AS (SELECT c, list({floor} ORDER BY j) AS x FROM p{r} GROUP BY c), c{r + 1} AS (SELECT z.c, coalesce(m{r}.x, z.x) AS x FROM c{r} z LEFT JOIN m{r} USING (c)), "
        for r in range(3))
    return (
        "WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 64)::BIGINT) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64), "
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM v ORDER BY c LIMIT 16), "
        f"{rounds} a3 AS ({nearest.format(r=3)}), h AS (SELECT c, sha256(array_to_string(x, ',')) AS h FROM c3) "
        "SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256 "
        "FROM a3 JOIN h USING (c)")


O = {
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_filter_audit": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM t),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
o AS (SELECT f AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f)
    UNION ALL SELECT o.filter_order || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(o.filter_order, f)),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS filter, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1)::INT AS own,
    (SELECT sum(1 << (instr('ABCDE', substr(filter_order, k, 1)) - 1)::INT) FROM range(1, 6) r(k) WHERE k < step)::INT AS earlier
    FROM o, range(1, 6) q(step) WHERE length(filter_order) = 5),
r AS (SELECT part, filter_order, step, filter,
    sum(CASE WHEN mask & (own | coalesce(earlier, 0)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(earlier, 0) > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(earlier, 0) = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(earlier, 0) = 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, filter)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM r""",
    "op12_centroids": _clustering_sql(),
}
