"""Run the named queries next to their SQL: python tests/check_queries.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted, missing values alike."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c] + 0.0
        elif not pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns), ignore_index=True)


def difference(got: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    """What is different between two results, or None."""
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} / {sorted(wanted.columns)}"
    if len(got) != len(wanted):
        return f"rows {len(got)} / {len(wanted)}"
    types = {c: (str(got[c].dtype), str(wanted[c].dtype)) for c in got.columns}
    other = {c: t for c, t in types.items() if t[0] != t[1]}
    if other:
        return f"types {other}"
    a, b = normal(got), normal(wanted)
    for c in a.columns:
        kinds = pd.api.types.is_float_dtype(a[c]), pd.api.types.is_float_dtype(b[c])
        if kinds[0] != kinds[1]:
            return f"type of {c}: {got[c].dtype} / {wanted[c].dtype}"
        if kinds[0]:
            same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        else:
            same = (a[c].astype(object) == b[c].astype(object)) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c} in {(~same).sum()} rows, e.g. {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from faultline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf)
    for name in chosen:
        start = time.time()
        try:
            got = queries()[name](spark, sf).toPandas()
            took = time.time() - start
            if name in oracle_sql():
                start = time.time()
                wanted = connection.execute(oracle_sql()[name]).df()
                verdict = difference(got, wanted) or "same"
                verdict += f" (sql {time.time() - start:.1f}s)"
            else:
                verdict = "no sql"
            print(f"## {name}: {len(got)} rows in {took:.1f}s, {verdict}", flush=True)
        except Exception as e:
            print(f"## {name}: FAILED {type(e).__name__} {str(e)[:1500]}", flush=True)
