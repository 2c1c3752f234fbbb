"""State of a search, written before every step, from which it goes on where it was stopped.

A state is one record of text (JSON, numbers written so that they read back exactly) in a folder of its own; it counts once
Spark has committed the folder, so a driver that dies while writing leaves the one before.  It holds no data of the
alignment: trees, lengths, model parameters and the place in the search, a bounded amount per search.
"""

from __future__ import annotations

import json
import logging
from dataclasses import replace

import numpy as np
from pyspark.sql import SparkSession

from cladeframe.functions.models import Model
from cladeframe.operators.likelihood import Topology
from cladeframe.sources.store import RunStore

log = logging.getLogger("cladeframe")
VERSION = 1
#: What of a model can change while it is fitted.
FITTED = ("rates", "freqs", "symmetry", "pinv", "alpha", "cat_rates", "cat_weights", "scaler")
#: Fields of a search that are plain values, with what an older record is taken to say.
PLAIN = {"search_id": 0, "weight_row": 0, "loglh": -np.inf, "radius": 0, "active": True, "limits": None, "cut": np.inf, "cost_sum": 0.0, "cost_n": 0}


def _plain(x):
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    return x


def model_state(m: Model) -> dict:
    return {k: _plain(getattr(m, k)) for k in FITTED}


def with_state(m: Model, state: dict) -> Model:
    """The model with fitted values of a record; what the record lacks stays as it is."""
    kept = {k: v for k, v in state.items() if k in FITTED}
    return replace(m, **{k: np.array(v, dtype=float) if k in ("rates", "freqs", "cat_rates", "cat_weights") and v is not None else v for k, v in kept.items()})


def search_state(s) -> dict:
    """A search as plain values; neighbours keep their order, as ties between moves follow it."""
    out = {k: _plain(getattr(s, k)) for k in PLAIN}
    out["limits"] = list(s.limits)
    out["tips"], out["near"] = s.tree.tips, [[v, [[w, float(t)] for w, t in m.items()]] for v, m in s.tree.near.items()]
    out["models"] = {str(p): model_state(m) for p, m in s.models.items()}
    out["lengths"] = {str(p): [[v, float(t)] for v, t in own.items()] for p, own in s.lengths.items()}
    return out


def restore(s, state: dict) -> None:
    """Put a record into a search that has the models to be fitted; fields that the record lacks keep what ``s`` has."""
    for k in PLAIN:
        if state.get(k) is not None:
            setattr(s, k, tuple(state[k]) if k == "limits" else state[k])
    s.tree = Topology({v: {w: t for w, t in m} for v, m in state["near"]}, state["tips"])
    s.models = {p: with_state(m, state.get("models", {}).get(str(p), {})) for p, m in s.models.items()}
    s.lengths = {int(p): {v: t for v, t in own} for p, own in state.get("lengths", {}).items()}


class Checkpoint:
    """States of one run, numbered; the newest that can be read is the one to go on from."""

    KIND = "state"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store, self.number = spark, RunStore(spark, path), 0

    def save(self, place: dict, searches) -> None:
        record = {"version": VERSION, **place, "searches": [search_state(s) for s in searches]}
        self.number += 1
        self.store.save(self.KIND, self.number, self.spark.createDataFrame([(self.number, json.dumps(record))], "number INT, record STRING").coalesce(1))
        if self.number > 2:
            self.store.forget(self.KIND, self.number - 2)

    def load(self) -> dict | None:
        """The newest record whose version is known; unreadable ones are passed over."""
        rows = self.store.load(self.KIND)
        if rows is None:
            return None
        for r in rows.select("number", "record").orderBy("number", ascending=False).collect():
            self.number = max(self.number, r["number"])
            try:
                record = json.loads(r["record"])
                if record["version"] <= VERSION and all("near" in s for s in record["searches"]):
                    return record
            except (ValueError, KeyError, TypeError):
                pass
            log.warning("state %d of the run can't be read", r["number"])
        return None
