"""Run registered queries and their SQL side by side: python tests/compare.py sf_dir [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def canonical(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when rows, columns and values agree."""
    result = con.sql(sql)
    expected_columns, expected = result.columns, result.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    a, b = canonical(df.columns, got), canonical(expected_columns, expected)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {str(bad[0])[:900]}" if bad else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from litsearch.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    sqls, failed = oracle_sql(), []
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problem = difference(df, con, sqls[name]) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        if problem:
            failed.append(name)
        print(f"{name:26s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print("failed:", failed)
