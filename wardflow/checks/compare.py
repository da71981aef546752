"""Side-by-side check of a Spark query against its DuckDB oracle.

Mirrors the driver's gate: same row count, same column names, and the same
multiset of rows (order-insensitive).  Values are compared exactly, so the
rounding idiom on both sides must agree bit for bit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                "events", "documents", "embeddings", "pages", "benchmark", "labels",
                "conversations")


def duckdb_connection(sf_dir: str):
    import os

    import duckdb

    con = duckdb.connect()
    for name in DRIVER_VIEWS:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), str(x)) for x in row)


@dataclass
class Outcome:
    name: str
    ok: bool
    spark_rows: int
    oracle_rows: int
    detail: str = ""


def rows_of(columns: list[str], records: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in records]
    return cols, sorted(rows, key=_key)


SPARK_TO_DUCKDB = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def compare(name: str, spark_df, con, sql: str) -> Outcome:
    s_cols = spark_df.columns
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    o_cols = [d[0] for d in rel.description]
    o_types = {d[0]: str(d[1]) for d in rel.description}
    o_rows = rel.fetchall()
    bad_types = [(c, s_types[c], o_types.get(c)) for c in s_cols
                 if c in o_types and SPARK_TO_DUCKDB.get(s_types[c], s_types[c]) != o_types[c]]
    if bad_types:
        return Outcome(name, False, len(s_rows), len(o_rows), f"types differ: {bad_types}")
    sc, sr = rows_of(s_cols, s_rows)
    oc, orows = rows_of(o_cols, o_rows)
    if sc != oc:
        return Outcome(name, False, len(sr), len(orows), f"columns differ: {sc} vs {oc}")
    if len(sr) != len(orows):
        return Outcome(name, False, len(sr), len(orows), "row counts differ")
    diffs = [(a, b) for a, b in zip(sr, orows) if a != b]
    if diffs:
        return Outcome(name, False, len(sr), len(orows),
                       f"{len(diffs)} rows differ, first: {diffs[0][0]} vs {diffs[0][1]}")
    return Outcome(name, True, len(sr), len(orows))
