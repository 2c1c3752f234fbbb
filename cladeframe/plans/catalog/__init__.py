"""Registered queries: name -> callable(spark, sf_dir), and the SQL oracle of each."""

from __future__ import annotations

import importlib

MODULES = ("alignment", "trees", "likelihoods", "operations", "files")


def registry() -> tuple[dict, dict]:
    q: dict = {}
    o: dict = {}
    for name in MODULES:
        try:
            m = importlib.import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{name}":
                raise
            continue
        q.update(m.Q)
        o.update(m.O)
    return q, o
