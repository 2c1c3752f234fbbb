"""Side-by-side comparison of a registered query with its SQL oracle."""

import time

import duckdb
import numpy as np

from cladeframe.plans.catalog import registry

QUERIES, ORACLES = registry()

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def val(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(val(x) for x in v)
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.9g}"
        return str(v)

    return sorted(tuple(val(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, con, d, name):
    t = time.time()
    df = QUERIES[name](spark, d)
    rows = [tuple(r) for r in df.collect()]
    sec = time.time() - t
    got, gc = norm(rows, df.columns)
    sql = ORACLES.get(name)
    if sql is None:
        return "rows", f"{len(rows)} rows {df.columns}", sec
    cur = con.execute(sql)
    wc = [c[0] for c in cur.description]
    want, wc = norm(cur.fetchall(), wc)
    types = {c[0]: str(c[1]) for c in con.execute(sql).description}
    stypes = dict(df.dtypes)
    odd = [(c, stypes[c], types.get(c)) for c in stypes if not _same(stypes[c], types.get(c, ""))]
    if gc != wc:
        return "FAIL", f"columns {gc} vs {wc}", sec
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return "FAIL", f"{len(got)} vs {len(want)} rows; only spark {list(a)[:3]}; only sql {list(b)[:3]}", sec
    return "ok", f"{len(got)} rows" + (f" TYPES {odd}" if odd else "") + (" EMPTY" if not got else ""), sec


def _same(s, d):
    return {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN"}.get(s, s) == d
