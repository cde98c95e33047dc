"""Side-by-side comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _kind(dtype: pa.DataType) -> str:
    if pa.types.is_integer(dtype):
        return "integer"
    if pa.types.is_floating(dtype):
        return "double"
    if pa.types.is_string(dtype) or pa.types.is_large_string(dtype):
        return "string"
    if pa.types.is_timestamp(dtype):
        return "timestamp"
    if pa.types.is_null(dtype):
        return "any"
    return str(dtype)


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table.column(name).to_pylist()] for name in names]
    return sorted(zip(*columns), key=repr) if columns else []


def compare(spark, folder: str, query, connection) -> tuple[int, list[str]]:
    """(row count, differences) of one query."""
    left = query.frame(spark, folder).toArrow()
    right = connection.sql(query.oracle()).to_arrow_table()
    problems = []
    if sorted(left.column_names) != sorted(right.column_names):
        return left.num_rows, [
            f"columns {sorted(left.column_names)} != {sorted(right.column_names)}"
        ]
    for name in left.column_names:
        a, b = _kind(left.schema.field(name).type), _kind(right.schema.field(name).type)
        if a != b and "any" not in (a, b):
            problems.append(
                f"type of {name}: {left.schema.field(name).type} != {right.schema.field(name).type}"
            )
    if left.num_rows != right.num_rows:
        problems.append(f"rows {left.num_rows} != {right.num_rows}")
    a, b = rows_of(left), rows_of(right)
    if a != b:
        names = sorted(left.column_names)
        ours, theirs = set(a) - set(b), set(b) - set(a)
        problems.append(f"{len(ours)} / {len(theirs)} rows differ; columns {names}")
        problems += [f"  spark {row}" for row in sorted(ours, key=repr)[:3]]
        problems += [f"  sql   {row}" for row in sorted(theirs, key=repr)[:3]]
    return left.num_rows, problems
