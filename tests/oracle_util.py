"""Compare a Spark result with DuckDB SQL the way the driver does:
same column names, same row count, same multiset of rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _scalar(v):
    if v is None:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        return v
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if hasattr(v, "item"):
        return v.item()
    return v


def _norm(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        pdf[c] = pd.Series([_scalar(v) for v in pdf[c]], index=pdf.index, dtype=object)
    return pdf.sort_values(list(pdf.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns {sorted(s.columns)} != {sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"rows {len(s)} != {len(d)}"
    a, b = _norm(s), _norm(d)
    for c in a.columns:
        if list(a[c]) != list(b[c]):
            bad = [(x, y) for x, y in zip(a[c], b[c]) if x != y][:3]
            return False, f"values differ in {c}: {bad}"
    return True, f"{len(s)} rows"
