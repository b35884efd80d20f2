"""Compare a query with its SQL, as rows without order."""

import os

import duckdb
import pandas as pd


def database(d):
    con = duckdb.connect()
    for f in os.listdir(d):
        p = f"{d}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


def norm(df):
    for c in df.columns:
        if len(df) and type(df[c].iloc[0]).__name__ in ("ndarray", "list"):
            df[c] = df[c].map(lambda x: None if x is None else [y.item() if hasattr(y, "item") else y for y in x])
    return df


def difference(spark, fn, sql, d):
    """Empty if the two agree; else what differs."""
    a, b = norm(fn(spark, d).toPandas()), norm(database(d).execute(sql).df())
    for c in set(a.columns) & set(b.columns):
        if "Int64" in (str(a[c].dtype), str(b[c].dtype)):  # whole numbers with nulls among them
            for df in (a, b):
                df[c] = df[c].astype(object).map(lambda x: None if pd.isna(x) else int(x) if x == int(x) else x)
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(rows(a), rows(b), strict=True) if x != y]
    kinds = [(c, str(a[c].dtype), str(b[c].dtype)) for c in a.columns if str(a[c].dtype) != str(b[c].dtype)]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else f"types {kinds}" if kinds else ""
