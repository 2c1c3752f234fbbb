"""Partition files and output names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cladeframe.operators import partitions as P

LINE = re.compile(r"^(?P<model>.+?),(?P<name>[^=,]+)=(?P<ranges>.+)$")

# Suffixes of the result files.
OUTPUTS = {
    "invalid": "invalidCells",
    "log": "log", "checkpoint": "ckp", "start_tree": "startTree", "best_tree": "bestTree", "best_model": "bestModel",
    "partition_trees": "bestPartitionTrees", "ml_trees": "mlTrees", "bootstrap_trees": "bootstraps", "support_tree": "support",
    "fbp_support_tree": "supportFBP", "tbe_support_tree": "supportTBE", "terrace": "terrace", "binary_msa": "rba",
    "bootstrap_msa": "bootstrapMSA", "rfdist": "rfDistances", "cons_tree": "consensusTree", "asr_tree": "ancestralTree",
    "asr_probs": "ancestralProbs", "asr_states": "ancestralStates", "terrace_compressed": "terraceCompressed",
}
TAG = "cladeframe"


@dataclass
class Part:
    part_id: int
    name: str
    model: str
    ranges: str


def parse_scheme(text: str) -> list[Part]:
    """Lines ``MODEL, name = ranges``; blanks are ignored, errors name their line."""
    out: list[Part] = []
    for no, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"\s", "", raw)
        if not line:
            continue
        # braces may hold commas, so the name starts after the last comma before '='
        head, eq, ranges = line.partition("=")
        model, comma, name = head.rpartition(",")
        if not (eq and comma and model and name and ranges):
            raise ValueError(f"partition file line {no}: expected 'MODEL, name = ranges'")
        out.append(Part(len(out), name, model, ranges))
    if len({p.name for p in out}) != len(out):
        raise ValueError("partition names must be unique")
    return out


def read_scheme(spark: SparkSession, path: str) -> list[Part]:
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return parse_scheme(text)


def scheme_ranges(spark: SparkSession, parts: list[Part]) -> list[tuple[int, int, int, int]]:
    df = spark.createDataFrame([(p.part_id, p.ranges) for p in parts], "part_id INT, range_string STRING")
    return [(r.part_id, r.start, r.stop, r.stride) for r in P.parse_ranges(df).collect()]


def write_scheme(parts: list[Part], path: str | None = None, lengths: dict[int, int] | None = None,
                 models: dict[int, str] | None = None) -> str:
    """Scheme text; with ``lengths`` the ranges are the contiguous ones of the written alignment."""
    rows, start = [], 1
    for p in parts:
        ranges = p.ranges
        if lengths is not None:
            ranges = f"{start}-{start + lengths[p.part_id] - 1}"
            start += lengths[p.part_id]
        rows.append(f"{(models or {}).get(p.part_id, p.model)}, {p.name} = {ranges}")
    text = "\n".join(rows) + "\n"
    if path:
        with open(path, "w") as f:
            f.write(text)
    return text


def output_name(kind: str, prefix: str, msa: str = "", nofiles: bool = False) -> str:
    return "" if nofiles else f"{prefix or msa}.{TAG}.{OUTPUTS[kind]}"
