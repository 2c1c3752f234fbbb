"""Bootstrap convergence over a stream of replicate trees."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cladeframe.functions import newick as nw
from cladeframe.operators import halves as H
from cladeframe.operators.trees import _per_tree
from cladeframe.sources.store import RunStore


def half_distances(stream: DataFrame, labels: list[str], interval: int = 50, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """(prefix, perm, wrf, n_splits) of a stream of trees ``(tree_no, newick)``, each prefix once all its trees have come.

    The state of a block of permutations is its counts, and the trees that came before their turn: a tree is added once,
    trees may come in any order, and one that comes again before it was added counts once (a later one is passed over).
    """
    index = {x: i for i, x in enumerate(labels)}
    held = _per_tree(stream.select(F.col("tree_no").alias("tree_id"), "newick"),
                     lambda no, text: [(no, [s for s, _ in nw.splits(nw.parse(text), index)])], "tree_no BIGINT, splits ARRAY<STRING>")
    blocks = H.blocks_of(held, permutations)
    names = [c.split()[0] for c in H.WRF.split(", ")]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            added, data, waiting = pickle.loads(state.get[0])
            counts = H.HalfCounts.load(data)
        else:
            added, waiting, counts = 0, {}, H.HalfCounts(H.perms_of(key[0], permutations), len(labels), seed)
        out, known = [], {x: x for splits in waiting.values() for x in splits}
        for frame in frames:
            for no, splits in zip(frame["tree_no"], frame["splits"]):
                if no >= added:
                    waiting[int(no)] = [known.setdefault(x, x) for x in splits]  # a text is kept once, so trees that wait are small
            while added in waiting:
                run = []
                while added + len(run) in waiting and (not run or (added + len(run)) % interval):
                    run.append(waiting.pop(added + len(run)))
                counts.add_all(added, run)
                added += len(run)
                if added % interval == 0:
                    out += [(added, p, wrf, n) for p, wrf, n in counts.distances(added)]
        state.update((pickle.dumps((added, counts.dump(), waiting), protocol=5),))
        yield pd.DataFrame(out, columns=names)

    return blocks.groupBy("block").applyInPandasWithState(step, H.WRF, "counts BINARY", "append", GroupStateTimeout.NoTimeout)


class Watch:
    """A running check; ``report`` has a row per prefix up to the first that converged."""

    def __init__(self, query: StreamingQuery, store: RunStore, stopped: dict | None = None):
        self.query, self.store, self.stopped = query, store, {} if stopped is None else stopped

    def report(self) -> DataFrame | None:
        r = self.store.load("report")
        return None if r is None else r.drop("epoch")

    def converged(self) -> bool:
        r = self.report()
        return r is not None and not r.where("converged").isEmpty()

    def wait(self, poll: float = 0.5) -> DataFrame | None:
        """Until the stream ends or converges; then it is stopped, and the rest of its trees isn't read."""
        while self.query.isActive:
            if self.stopped:  # told by the batch itself, as a look at the table would be a job each time
                self.query.stop()
            else:
                time.sleep(poll)
        if self.query.exception() is not None:
            raise self.query.exception()
        return self.report()


def watch(stream: DataFrame, labels: list[str], path: str, interval: int = 50, permutations: int = 1000,
          cutoff: float = 0.03, seed: int = 1, on_report: Callable | None = None, trigger: dict | None = None) -> Watch:
    """Check convergence each time another ``interval`` trees ``(tree_no, newick)`` have arrived.

    Rows of a micro-batch are one table named by its epoch, overwritten if the epoch is replayed, so a prefix is reported once; after
    the first that converged no more are.
    """
    spark = stream.sparkSession
    store = RunStore(spark, f"{path}/state")
    told = store.load("report")
    first = None if told is None else told.where("converged").agg(F.min("epoch")).first()[0]
    stopped = {} if first is None else {"epoch": first}

    def batch(df: DataFrame, epoch: int) -> None:
        if stopped and stopped["epoch"] < epoch:
            return
        rows = sorted(tuple(r) for r in H.convergence(df, permutations, cutoff).collect())  # one for each prefix
        stop = next((r[0] for r in rows if r[4]), None)
        if rows:
            found = spark.createDataFrame([(*r, epoch) for r in rows if stop is None or r[0] <= stop], f"{H.REPORT}, epoch BIGINT")
            store.save("report", epoch, found.coalesce(1))
            if on_report:
                on_report(store.load("report").where(F.col("epoch") == epoch).drop("epoch"))
        if stop is not None:
            stopped["epoch"] = epoch

    query = half_distances(stream, labels, interval, permutations, seed).writeStream.foreachBatch(batch).option(
        "checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    return Watch(query, store, stopped)
