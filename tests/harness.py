"""Side-by-side check of a query and its SQL."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def _normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    rows = sorted(tuple(str(v) if v is not None and v == v else "NULL" for v in r) for r in frame.itertuples(index=False))
    return pd.DataFrame(rows, columns=sorted(frame.columns))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty text when both hold the same rows."""
    a, b = spark_frame.copy(), sql_frame.copy()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    for c in a.columns:
        if "Int64" in (str(a[c].dtype), str(b[c].dtype)):  # whole numbers with nulls, which pandas may hold as floats
            a[c], b[c] = (x[c].astype("Int64").astype(object).where(x[c].notna(), None) for x in (a, b))
            continue
        if a[c].dtype.kind in "iuf" and b[c].dtype.kind in "iuf" and a[c].dtype.kind != b[c].dtype.kind:
            return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        if a[c].dtype.kind in "iub" and b[c].dtype.kind in "iub":
            a[c], b[c] = a[c].astype("int64"), b[c].astype("int64")
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = _normal(a), _normal(b)
    if a.equals(b):
        return ""
    bad = (a != b).any(axis=1)
    return f"{bad.sum()} rows differ\n{a[bad].head(3).to_string()}\n{b[bad].head(3).to_string()}"
