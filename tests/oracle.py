"""Comparison of a query with its DuckDB SQL on the same parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = SF):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if glob.glob(f"{path}/*") else path
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(frame) -> list:
    cols = sorted(frame.columns)
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "~"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return int(v)
        return round(v, 6) + 0.0 if isinstance(v, float) else v
    rows = [tuple(one(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)]
    return [tuple(cols), *sorted(rows, key=repr)]


def differences(spark_frame, sql: str, sf_dir: str = SF) -> list:
    got, want = norm(spark_frame.toPandas()), norm(duck(sf_dir).sql(sql).df())
    if got[0] != want[0]:
        return [("columns", got[0], want[0])]
    if len(got) != len(want):
        return [("rows", len(got) - 1, len(want) - 1)]
    return [(g, w) for g, w in zip(got, want, strict=True) if g != w][:5]
