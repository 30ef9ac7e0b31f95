"""Holds a Spark result against DuckDB's."""

import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for t in sorted(os.listdir(folder)):
        if t.endswith(".parquet"):
            path = f"{folder}/{t}"
            c.execute(f"create view {t[:-8]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
        return round(float(v), 7) + 0.0
    if hasattr(v, "item"):
        v = v.item()
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(columns, data):
    return sorted((tuple(cell(r[c]) for c in columns) for r in data), key=repr)


def same(df, sql, folder):
    got = df.toPandas()
    want = connect(folder).execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(columns, got.astype(object).to_dict("records")) == rows(columns, want.astype(object).to_dict("records"))
