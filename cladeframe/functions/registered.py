"""Functions for SQL: ``register(spark)`` makes them known to a session.

``newick_splits(newick, taxa)`` and ``parse_model(text)`` are table functions for lateral joins; ``pattern_loglh(pattern, taxa, newick, model)`` is a
scalar function over batches of columns.  ``taxa`` are names with commas between.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F

from cladeframe.functions import newick as nw
from cladeframe.functions.kernel import Block, Rates
from cladeframe.functions.models import parse_model


@lru_cache(64)
def _index(taxa: str) -> dict[str, int]:
    return {x: i for i, x in enumerate(taxa.split(","))}


class NewickSplits:
    """Nontrivial splits of a tree: (split, length, label); none for a null."""

    def eval(self, newick, taxa):
        if newick is not None and taxa is not None:
            t = nw.parse(newick)
            for s, v in nw.splits(t, _index(taxa)):
                yield s, None if np.isnan(t.length[v]) else float(t.length[v]), t.label[v]


class ParseModel:
    """One row per model text: name, data type, states, categories, free parameters, written out with defaults."""

    def eval(self, text):
        if text is not None:
            m = parse_model(text)
            yield m.name, m.datatype, m.states, m.ncat, m.free_params(), m.text()


@lru_cache(64)
def _prepared(taxa: str, newick: str, model: str):
    from cladeframe.operators.likelihood import Topology

    m = parse_model(model)
    order, length = Topology.from_newick(newick, taxa.split(",")).rooted()
    return m, Rates(m), order, length


def _pattern_loglh(pattern: pd.Series, taxa: pd.Series, newick: pd.Series, model: pd.Series) -> pd.Series:
    out = np.full(len(pattern), np.nan)
    given = (pattern.notna() & taxa.notna() & newick.notna() & model.notna()).to_numpy()
    at = pd.Series(np.arange(len(pattern)))[given]
    for key, rows in at.groupby([taxa[given].to_numpy(), newick[given].to_numpy(), model[given].to_numpy()]):
        m, rates, order, length = _prepared(*key)
        x = np.frombuffer("".join(pattern.iloc[rows]).encode("latin-1"), dtype=np.uint8).reshape(len(rows), -1)
        out[rows] = Block(x, m.alphabet.table(), m.states).loglh(rates, order, length)
    return pd.Series(out).where(given)


def register(spark: SparkSession) -> None:
    spark.udtf.register("newick_splits", F.udtf(NewickSplits, returnType="split STRING, length DOUBLE, label STRING"))
    spark.udtf.register("parse_model", F.udtf(ParseModel, returnType="name STRING, datatype STRING, states INT, categories INT, free_params BIGINT, canonical STRING"))
    spark.udf.register("pattern_loglh", F.pandas_udf(_pattern_loglh, "double"))
