"""Compare a query with its SQL on the same tables."""

import decimal

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, bool):
        return v
    return round(float(v), 6) + 0.0 if isinstance(v, int | float | decimal.Decimal) else v


def rows(frame):
    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(_value, r)) for r in ordered.itertuples(index=False)), key=repr)
