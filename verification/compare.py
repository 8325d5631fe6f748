"""Run registered queries against their SQL: ``python -m verification.compare FOLDER [NAME…]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def check(spark, con, folder, name, function, sql):
    started = time.time()
    got = function(spark, folder)
    columns, rows = table(got.columns, [tuple(r) for r in got.collect()])
    seconds = time.time() - started
    if sql is None:
        return f"rows-only {len(rows)}", seconds
    expected = con.execute(sql)
    want_columns, want = table([d[0] for d in expected.description], expected.fetchall())
    if columns != want_columns:
        return f"COLUMNS {columns} != {want_columns}", seconds
    if rows == want:
        return f"ok {len(rows)}", seconds
    missing = [r for r in want if r not in set(rows)][:2]
    extra = [r for r in rows if r not in set(want)][:2]
    return f"DIFFERENT {len(rows)} vs {len(want)}\n   expected {missing}\n   got      {extra}", seconds


def main(folder: str, names: list[str]) -> int:
    from pixelhour.session import local_session
    from verification import oracle, registry

    spark = local_session("compare")
    con = connect(folder)
    failed = 0
    for name, function in registry.QUERIES.items():
        if names and name not in names:
            continue
        try:
            verdict, seconds = check(spark, con, folder, name, function, oracle.SQL.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict, seconds = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0
        failed += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:28s} {seconds:6.2f}s {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
