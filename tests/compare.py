"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, Decimal)):
        v = float(v)
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return str(v) if v is not None else None


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark_df, con, sql) -> list[str]:
    found = con.execute(sql)
    want_names = [d[0] for d in found.description]
    want_types = {d[0]: str(d[1]) for d in found.description}
    want = _rows(want_names, found.fetchall())
    got_names = spark_df.columns
    got = _rows(got_names, spark_df.collect())
    out = []
    if sorted(got_names) != sorted(want_names):
        out.append(f"columns {sorted(got_names)} != {sorted(want_names)}")
        return out
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for f in spark_df.schema:
        kind = kinds.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        if kind != want_types[f.name]:
            out.append(f"type of {f.name}: {kind} != {want_types[f.name]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        out.append(f"{len(bad)} rows differ, first (columns {sorted(got_names)}):\n   {bad[0][0]}\n   {bad[0][1]}")
    return out
