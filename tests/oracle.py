"""Compares a query with its SQL in DuckDB: columns, types and values without order."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        if (path := Path(sf_dir, f"{t}.parquet")).exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return db


def differences(query, sql: str, spark, sf_dir: str) -> str:
    ours, theirs = query(spark, sf_dir).toArrow(), connect(sf_dir).sql(sql).to_arrow_table()
    names = sorted(ours.column_names)
    if names != sorted(theirs.column_names):
        return f"columns {names} and {sorted(theirs.column_names)}"
    for n in names:
        if str(ours.schema.field(n).type) != str(theirs.schema.field(n).type):
            return f"{n}: {ours.schema.field(n).type} and {theirs.schema.field(n).type}"
    a, b = (sorted(map(repr, zip(*[t.column(n).to_pylist() for n in names], strict=True))) for t in (ours, theirs))
    return "" if a == b else f"{len(a)} and {len(b)} rows, first difference {next((x for x in zip(a, b, strict=False) if x[0] != x[1]), None)}"
