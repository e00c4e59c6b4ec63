"""Run named queries in Spark and their SQL twins in DuckDB and compare them.

    python tests/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return db


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, db, folder, name, build, sql):
    """(ok, message) of one query."""
    start = time.time()
    df = build(spark, folder)
    got = df.collect()
    spent = time.time() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
        if unwanted in plan:
            return False, f"{unwanted} in the plan"
    if sql is None:
        return True, f"rows only: {len(got)} rows  {spent:.1f}s"
    start = time.time()
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    want = result.fetchall()
    timing = f"spark {spent:.1f}s duckdb {time.time() - start:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}  {timing}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return False, f"{len(a)} rows against {len(b)}  {timing}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    close = [
        pair
        for pair in bad
        if not all(
            x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6)
            for x, y in zip(*pair)
        )
    ]
    if bad:
        x, y = (close or bad)[0]
        return False, f"{len(bad)} rows differ ({len(close)} beyond rounding), first:\n  {str(x)[:600]}\n  {str(y)[:600]}\n  {timing}"
    return True, f"{len(a)} rows match  {timing}"


def main():
    import __spark_entry__ as entry
    from lodestone.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("check")
    folder = f"/root/testdata/sf{args.sf}"
    db = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name in args.names or queries:
        try:
            ok, message = compare(spark, db, folder, name, queries[name], oracle.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if not ok:
            failed.append(name)
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
