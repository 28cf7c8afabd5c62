"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Mirrors the driver's gate: same column names, same row count, and the same
multiset of rows once doubles are rounded to 6 places.
"""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

_ARROW_OF_SPARK = {"bigint": "int64", "int": "int32", "double": "double", "string": "string",
                   "boolean": "bool", "timestamp": "timestamp[us, tz=UTC]",
                   "timestamp_ntz": "timestamp[us]", "date": "date32[day]",
                   "smallint": "int16", "tinyint": "int8", "float": "float"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(records):
    out = [tuple(_norm(x) for x in r) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df, sql: str, sf_dir: str, con=None) -> dict:
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    d_tbl = rel.arrow()
    if hasattr(d_tbl, "read_all"):
        d_tbl = d_tbl.read_all()
    s_cols = spark_df.columns
    d_cols = list(d_tbl.column_names)
    res = {"spark_cols": sorted(s_cols), "duck_cols": sorted(d_cols)}
    if sorted(s_cols) != sorted(d_cols):
        res["ok"] = False
        res["why"] = "columns differ"
        return res
    cols = sorted(s_cols)
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    d_types = {f.name: str(f.type) for f in d_tbl.schema}
    type_diff = {c: (s_types[c], d_types[c]) for c in cols
                 if _ARROW_OF_SPARK.get(s_types[c], s_types[c]) != d_types[c]}
    s_rows = _rows(tuple(r[c] for c in cols) for r in spark_df.collect())
    d_py = d_tbl.select(cols).to_pylist()
    d_rows = _rows(tuple(r[c] for c in cols) for r in d_py)
    res.update(spark_rows=len(s_rows), duck_rows=len(d_rows), type_diff=type_diff)
    if len(s_rows) != len(d_rows):
        res["ok"] = False
        res["why"] = "row count differs"
        return res
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    res["ok"] = not bad and not type_diff
    res["value_diffs"] = len(bad)
    if bad:
        res["why"] = "values differ"
        res["example"] = [bad[0][0], bad[0][1]]
    elif type_diff:
        res["why"] = "types differ"
    return res
