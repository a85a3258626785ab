"""Runs a registered query and its DuckDB counterpart side by side."""

from __future__ import annotations

import datetime
import decimal
import os
from pathlib import Path

import duckdb

SF_DIR = os.environ.get("QUERN_TEST_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = path if path.is_file() else path / "*.parquet"
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    """A value in a form that both engines' rows share."""
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


def differences(spark, name: str, query, sql: str, sf_dir: str = SF_DIR, limit: int = 3) -> list[str]:
    """What differs between the two results; empty when nothing does."""
    result = query(spark, sf_dir)
    ours = [tuple(r) for r in result.collect()]
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    out = []
    if sorted(names) != sorted(result.columns):
        return [f"{name}: columns {sorted(result.columns)} against {sorted(names)}"]
    if len(ours) != len(theirs):
        out.append(f"{name}: {len(ours)} rows against {len(theirs)}")
    a, b = rows_of(result.columns, ours), rows_of(names, theirs)
    if a != b:
        left, right = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        out += [f"{name}: spark only ({len(left)}) {x}" for x in left[:limit]] + [f"{name}: sql only ({len(right)}) {x}" for x in right[:limit]]
    return out
