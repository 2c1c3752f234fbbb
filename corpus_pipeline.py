"""Corpus preparation: stages in order, each written as Parquet and read again as the next one's documents.

Every stage works on all that the one before kept, and all but the last return the columns of documents.  Columns that
documents has beyond the known ones pass through, whatever their names.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeframe.llm import digest_index, langid, packing, repeats, weighted_minhash
from cladeframe.llm.common import made, release, scratch, stored, table

#: A document whose likeliest language has a smaller pooled probability is rejected, as is one without a letter.
LEAST_SCORE = 0.4
WINDOW_WORDS, SEQUENCE = 20, 2048


_left: list[str] = []


def stage(step):
    """When a stage begins, the result of the one before is written, so the tables it worked with can go."""
    @wraps(step)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        mark = len(made)
        out = step(spark, docs, sf_dir)
        _left[:] = made[mark:]
        return out
    return begin


def _wrapped(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): the other columns in a struct, so that no name clashes with a result."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).dropFields("text").alias("doc"))


def _unwrapped(found: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` in their order; the text beside the struct."""
    return found.select(*[changed.get(c, F.col("text") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; it learns from the labelled ones among them.

    If none of them has a label, no language can be told, and only texts without a letter are rejected.
    """
    net = langid.train(langid.samples(docs, "text", "lang", "doc_id"))
    if not net.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(_wrapped(docs).select("text", "doc"), net)
    return _unwrapped(found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)), docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: the one with the smallest doc_id.  Null counts as an empty text."""
    index = digest_index.DigestIndex(spark, scratch(spark, "index"))
    found = digest_index.deduplicate(_wrapped(docs), index, with_text=True)
    index.close()
    return _unwrapped(found.where("kept"), docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the smallest doc_id, rows without one last.

    Rows are numbered first, so rows that share a doc_id are judged each by its own text.
    """
    rows = stored(_wrapped(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = weighted_minhash.classes(rows.select("row", "text"), key="row")
    named = found.hint("merge").join(rows.select("row", "doc_id"), "row")
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"))
    kept = stored(first.select(F.col("first.row").alias("row")), "first")
    return _unwrapped(rows.hint("merge").join(kept, "row", "left_semi"), docs)


@stage
def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeat a window of an earlier place; a document that has lost all its words goes.

    A changed text is its kept words with one space between; ``n_chars`` follows it.  Other texts stay as they are.
    """
    found = repeats.deduplicate(_wrapped(docs), WINDOW_WORDS, with_text=True).where("n_removed < n_words OR n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return _unwrapped(found, docs, **changed)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens; a null text counts as empty.  Other columns end here."""
    pieces = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, 1, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("exact", exact), ("near", near), ("substring", substring), ("pack", pack)]
#: The stages learn a network and sample weighted sets, so SQL can't give the rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stored(step(spark, docs, sf_dir), name)
    return docs
