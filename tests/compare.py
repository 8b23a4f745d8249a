"""Rows of a query against its DuckDB twin."""

import glob
import math

import duckdb

import __spark_entry__ as entry


def rows(df):
    cols = sorted(df.columns)
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "item") and not isinstance(v, bool) else v
    return sorted((tuple(str(clean(r[c])) for c in cols) for r in df.to_dict("records")), key=str), cols


def twin(sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {p.rsplit('/', 1)[1][:-8]} as select * from '{p}'")
    return con.execute(entry.oracle_sql()[name]).df()


def differing(spark, sf_dir, name):
    """None if equal, else what differs."""
    a, b = entry.queries()[name](spark, sf_dir).toPandas(), twin(sf_dir, name)
    import pandas as pd

    for d in (a, b):
        for c in d.columns:
            if pd.api.types.is_numeric_dtype(d[c]) and not pd.api.types.is_bool_dtype(d[c]):
                d[c] = d[c].astype(float)
            elif d[c].dtype == object and len(d) and d[c].map(lambda v: v is None or isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal").all():
                d[c] = d[c].astype(float)
    (x, cx), (y, cy) = rows(a), rows(b)
    if cx != cy:
        return f"columns {cx} {cy}"
    if len(x) != len(y):
        return f"rows {len(x)} {len(y)}"
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    return f"{len(bad)} of {len(x)} rows differ: {bad[:2]}" if bad else None
