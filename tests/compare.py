"""Compares a query with its SQL on the same Parquet tables."""

import math
from pathlib import Path

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if v is not None and type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(((tuple(_norm(r[i]) for i in order)) for r in rows), key=repr)


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    out = con.execute(sql)
    return rows_of([d[0] for d in out.description], out.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
