"""Alignment readers: row-oriented text formats turned into one row per column.

Every format becomes segments ``(taxon_id, start, text)``; segments that cover the same run
of columns meet in one bounded group (taxa x run) and are transposed there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.sites import dense_offsets
from cladeframe.sources.text import exists, head, numbered_records

RUN = 4096
FORMATS = ("auto", "fasta", "phylip", "iphylip", "catg", "vcf", "binary")


@dataclass
class Alignment:
    """Columns plus the taxon list, which fixes the order of symbols in ``pattern``."""

    sites: DataFrame
    labels: list[str]
    probs: DataFrame | None = None
    partitions: list | None = None
    patterns: DataFrame | None = None
    #: One row per column with a probability vector per taxon: (part_id, site, vectors).
    vectors: DataFrame | None = None

    @property
    def taxa(self) -> DataFrame:
        return self.sites.sparkSession.createDataFrame(list(enumerate(self.labels)), "taxon_id BIGINT, label STRING")


class FormatError(ValueError):
    pass


def _transpose(segments: DataFrame, n_taxa: int) -> DataFrame:
    """(run, start, taxon_id, text) -> (site, pattern); a run must be complete and even."""
    g = segments.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("taxon_id", "text"))).alias("s"))

    def cols(it):
        for pdf in it:
            for start, s in zip(pdf.start, pdf.s):
                text = [x["text"] for x in s]
                if len(text) != n_taxa or len({len(t) for t in text}) != 1:
                    raise FormatError(f"sequences differ in length near column {start + 1}")
                m = np.array([list(t.encode("latin-1")) for t in text], dtype=np.uint8).T
                yield pd.DataFrame({"part_id": 0, "site": np.arange(start, start + len(m)),
                                    "pattern": [r.tobytes().decode("latin-1") for r in np.ascontiguousarray(m)]})

    return g.mapInPandas(cols, "part_id INT, site BIGINT, pattern STRING")


def _sliced(sequences: DataFrame, run: int = RUN) -> DataFrame:
    """(taxon_id, sequence) -> segments of ``run`` columns."""
    n = F.greatest(F.ceil(F.length("sequence") / run), F.lit(1))
    e = sequences.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)))
    return e.select("taxon_id", (F.col("k") * run).alias("start"),
                    F.substring(F.col("sequence"), (F.col("k") * run + 1).cast("int"), F.lit(run)).alias("text"))


def read_fasta(spark: SparkSession, path: str) -> Alignment:
    """One record per '>'; labels are the header line without trailing blanks."""
    rec = numbered_records(spark, path, ">")
    lines = F.split("value", "\r?\n", 2)
    seq = rec.select("line", F.rtrim(lines[0]).alias("label"), F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"))
    info = seq.select("line", "label", F.length("sequence").alias("n")).orderBy("line").collect()
    if not info or any(r["label"] == "" for r in info):
        raise FormatError("FASTA: empty file or label")
    if any(r["n"] == 0 for r in info) or len({r["n"] for r in info}) != 1:
        raise FormatError("FASTA: sequences are empty or differ in length")
    labels = [r["label"] for r in info]
    return Alignment(_transpose(_sliced(seq.withColumnRenamed("line", "taxon_id")), len(labels)), labels)


HEADER = re.compile(r"^\s*(\d+)\s+(\d+)\s*$")


def _phylip_lines(spark, path):
    lines = numbered_records(spark, path)
    first = lines.where("line = 0").first()
    m = HEADER.match(first["value"]) if first else None
    if not m:
        raise FormatError("PHYLIP: invalid header")
    body = lines.where("line > 0").withColumn("k", F.col("line") - 1)
    return int(m.group(1)), int(m.group(2)), body


def read_phylip(spark: SparkSession, path: str, interleaved: bool = False) -> Alignment:
    """Sequential or interleaved; sequences may wrap over any even number of lines."""
    n, length, body = _phylip_lines(spark, path)
    count = body.count()
    if n < 1 or count % n:
        raise FormatError(f"PHYLIP: {count} sequence lines do not fit {n} taxa")
    per = count // n
    block, taxon = (F.floor(F.col("k") / n), F.col("k") % n) if interleaved else (F.col("k") % per, F.floor(F.col("k") / per))
    p = body.select(block.alias("block"), taxon.alias("taxon_id"), F.trim("value").alias("value"))
    name = F.regexp_extract("value", r"^(\S+)", 1)
    text = F.when(F.col("block") == 0, F.regexp_replace("value", r"^\S+\s*", "")).otherwise(F.col("value"))
    seg = p.select("block", "taxon_id", name.alias("label"), F.regexp_replace(text, r"\s", "").alias("text"))
    labels = [r["label"] for r in seg.where("block = 0").select("taxon_id", "label").orderBy("taxon_id").collect()]
    total = seg.groupBy("taxon_id").agg(F.sum(F.length("text")).alias("n")).where(F.col("n") != length).limit(1).collect()
    if total:
        raise FormatError(f"PHYLIP: sequence {labels[total[0]['taxon_id']]} has {total[0]['n']} columns, not {length}")
    if per == 1:
        return Alignment(_transpose(_sliced(seg.select("taxon_id", F.col("text").alias("sequence"))), n), labels)
    width = seg.where("taxon_id = 0").select("block", F.length("text").alias("w"))
    start = dense_offsets(width, "block", F.col("w"), name="start").select("block", "start")
    return Alignment(_transpose(seg.join(start, "block").select("taxon_id", "start", "text"), n), labels)


# Fixed value: column order of DNA probabilities in CATG files, as positions in ACGT.
CATG_DNA = "CATG"


def read_catg(spark: SparkSession, path: str) -> Alignment:
    """Column-wise: consensus symbols and one probability list per taxon and column."""
    n, length, body = _phylip_lines(spark, path)
    names = body.where("k = 0").first()
    labels = names["value"].split() if names else []
    if len(labels) != n:
        raise FormatError("CATG: wrong number of taxon labels")
    tok = F.split(F.trim("value"), r"\s+")
    rows = body.where("k > 0").select((F.col("k") - 1).alias("site"), tok.alias("t"))
    probs = F.transform(F.slice("t", 2, n), lambda x: F.transform(F.split(x, ","), lambda v: v.try_cast("double")))
    order = [CATG_DNA.index(c) for c in "ACGT"]

    def dna_order(p):
        return F.when(F.size(p) == 4, F.array(*[F.get(p, F.lit(i)) for i in order])).otherwise(p)

    wide = rows.select("site", F.element_at("t", 1).alias("pattern"), F.size("t").alias("_k"), F.transform(probs, dna_order).alias("probs"))
    bad = F.exists("probs", lambda p: F.exists(p, lambda v: v.isNull()))
    ok = (F.length("pattern") == n) & (F.col("_k") == n + 1) & ~bad
    checked = wide.select(F.lit(0).alias("part_id"), "site", F.when(ok, F.col("pattern")).otherwise(F.raise_error(
        F.concat(F.lit("CATG: malformed column "), (F.col("site") + 1).cast("string"))).cast("string")).alias("pattern"), "probs")
    found = rows.count()
    if found != length:
        raise FormatError(f"CATG: {found} columns, not {length}")
    cells = checked.select("part_id", "site", F.posexplode("probs").alias("taxon_id", "probs"))
    return Alignment(checked.drop("probs"), labels, cells, vectors=checked.select("part_id", "site", F.col("probs").alias("vectors")))


def _phylip_kind(spark: SparkSession, path: str, n: int) -> str:
    """Which layout follows a PHYLIP header: told by the shape of whole lines, however long, as measured in the tasks."""
    tok = F.split(F.trim("value"), r"\s+")
    shapes = numbered_records(spark, path).where(F.col("line").isin(1, 2, n + 1, n + 2)).select(
        "line", F.size(tok).alias("tokens"), F.length(tok[0]).alias("first"), F.contains(F.coalesce(F.get(tok, F.lit(1)), F.lit("")), F.lit(",")).alias("lists"),
        F.length(F.array_join(tok, "")).alias("letters"))
    at = {r["line"]: r for r in shapes.collect()}
    one, two = at.get(1), at.get(2)
    if one and two and one["tokens"] == n and two["tokens"] == n + 1 and two["first"] == n and two["lists"]:
        return "catg"
    if one and two and n + 1 in at and one["tokens"] > 1 and two["tokens"] > 1:
        # in the sequential layout line two continues the first taxon: it has no name of its own
        return "iphylip" if one["letters"] - one["first"] == two["letters"] - two["first"] else "phylip"
    return "phylip"


def sniff(spark: SparkSession, path: str) -> str:
    """Format of a file from its first bytes."""
    if exists(spark, f"{path}/_alignment.json") or exists(spark, f"{path}/meta"):
        return "binary"
    text = head(spark, path)
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        raise FormatError("empty alignment file")
    if lines[0].startswith(">"):
        return "fasta"
    if lines[0].startswith("##fileformat=VCF"):
        return "vcf"
    m = HEADER.match(lines[0])
    if m:
        return _phylip_kind(spark, path, int(m.group(1)))
    raise FormatError("unknown alignment format")


def read_alignment(spark: SparkSession, path: str, fmt: str = "auto") -> Alignment:
    if fmt not in FORMATS:
        raise ValueError(f"unknown alignment format: {fmt}")
    kind = sniff(spark, path) if fmt == "auto" else fmt
    if kind == "fasta":
        return read_fasta(spark, path)
    if kind in ("phylip", "iphylip"):
        return read_phylip(spark, path, kind == "iphylip")
    if kind == "catg":
        return read_catg(spark, path)
    if kind == "binary":
        from cladeframe.sources.store import read_store
        return read_store(spark, path)
    raise NotImplementedError("VCF alignments are not supported")
