"""What several operators share: tables, scratch tables in the shared folder, bounded Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from cladeframe.session import shared_dir

#: Text handled at a time inside a task, in bytes (a single longer text is a slice of its own).
SLICE_BYTES = (1 << 20) - 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that scratch() has given out, in order.
made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return made[-1]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables under scratch paths.  Only for those that no unfinished result reads."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there and nothing is computed twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The table without columns that results will carry; a clashing input column gives way."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each row, plus the end; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (of one column, or several named with spaces between) have at most ``limit`` bytes, or one row."""
    off = sum(utf8(batch.column(c))[1] for c in columns.split())
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def map_slices(df: DataFrame, text: str, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], dict]],
               at_end: Callable | None = None) -> DataFrame:
    """``mapInArrow`` over bounded slices.

    ``text`` names one column, or several with spaces between.  ``make`` runs once per task and gives a function from a slice to the output columns (numpy arrays, lists or Arrow
    arrays by name); columns of the same name as an input column may be left out and are then passed on.
    """
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                yield record(arrow, work(part), part)
        if at_end is not None and (last := at_end(work)) is not None:
            yield record(arrow, last, None)

    few_rows(df.sparkSession)
    return df.mapInArrow(run, schema)


def few_rows(spark: SparkSession) -> None:
    """Texts come to tasks by this many rows at a time, unless the session says otherwise: its default is meant for numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def record(schema: pa.Schema, columns: dict, part: pa.RecordBatch | None) -> pa.RecordBatch:
    out = []
    for f in schema:
        c = columns[f.name] if f.name in columns else part.column(f.name)
        out.append(c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)
