"""Compare registered queries with their DuckDB oracles.

    python -m tests.oracle [--sf 0.01] [pattern ...]
"""

from __future__ import annotations

import fnmatch
import math
import os
import sys
import time
from glob import glob

import duckdb
from pyspark.sql import SparkSession

DATA = os.environ.get("TESTDATA", "/root/testdata")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("barlume-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob(f"{DATA}/sf{sf}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)


def compare(df, con, sql):
    """None when equal, else a short description of the first difference."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    if sorted(want_cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}", len(got)
    want = rows_of(want_cols, cur.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, {sorted(df.columns)}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", len(got)
    return None, len(got)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    names = [n for n in queries() if not args or any(fnmatch.fnmatch(n, a) for a in args)]
    spark, con, oracles = session(), connect(sf), oracle_sql()
    failed = []
    for n in names:
        t0 = time.time()
        try:
            df = queries()[n](spark, f"{DATA}/sf{sf}")
            if n in oracles:
                msg, rows = compare(df, con, oracles[n])
            else:
                msg, rows = None, len(df.collect())
        except Exception as e:
            msg, rows = f"{type(e).__name__}: {str(e)[:600]}", -1
        state = "FAIL" if msg else ("ok" if n in oracles else "rows")
        print(f"{state:5} {time.time() - t0:6.2f}s {rows:7d} {n} {msg or ''}", flush=True)
        if msg:
            failed.append(n)
    print(f"{len(names)} queries, {len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
