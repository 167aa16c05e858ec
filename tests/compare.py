"""Rows of a DataFrame and of DuckDB in one comparable form."""

from __future__ import annotations

import math
import os

import duckdb


def cell(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6) + 0.0 if math.isfinite(v) else str(v)
    return str(v)


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([cell(v) for v in r]) for r in frame.astype(object).values.tolist())


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return c
