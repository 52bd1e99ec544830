"""Runs a registered query and its SQL side by side and compares every value."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"f:{v!r}"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return f"d:{v}"
    return f"s:{v}"


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    got_cols, got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = canon([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first spark={bad[0][0]} sql={bad[0][1]} ({got_cols})"
    return None


def main(argv):
    import __spark_entry__ as entry
    from formline.session import local_session

    folder = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    prefixes = argv or [""]
    spark, con = local_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(fn(spark, folder), con, oracles[name])
            else:
                problem = None if fn(spark, folder).collect() else "no rows"
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        mark = "FAIL" if problem else ("ok" if name in oracles else "ok (rows)")
        print(f"{name:40s} {time.time() - start:6.2f}s {mark} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
