"""Row-for-row comparison of a Spark result with the same query in DuckDB, order ignored."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def differences(df, con, sql) -> list[str]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    types = {d[0]: str(d[1]) for d in result.description}
    problems = []
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind) != types[name]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    got = df.collect()
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    left, right = _rows(df.columns, got), _rows(columns, expected)
    if left != right:
        odd = [(a, b) for a, b in zip(left, right) if a != b]
        problems.append(f"{len(odd)} rows differ, first {odd[:2]}")
    return problems
