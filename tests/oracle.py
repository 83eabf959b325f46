"""Run registered queries and compare them with their SQL twin. ``python tests/oracle.py [--sf DIR] [prefix…]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import threading
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cpus: int = int(os.environ.get("TEST_CPUS", "8"))):
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "6g").config("spark.log.level", "ERROR")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def connect(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(x[i]) for i in order) for x in data), key=repr)


def compare(spark_cols, spark_rows, duck_cols, duck_rows):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} against {sorted(duck_cols)}"
    a, b = rows(spark_cols, spark_rows), rows(duck_cols, duck_rows)
    if len(a) != len(b):
        return f"rows {len(a)} against {len(b)}; first {a[:2]} {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {sorted(spark_cols)}: {bad[0][0]} against {bad[0][1]}"
    return None


def check(name, spark, con, sf, fn, sql):
    start = time.time()
    timer = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        df = fn(spark, sf)
        got = [tuple(x) for x in df.collect()]
    finally:
        timer.cancel()
    took = time.time() - start
    if sql is None:
        return took, len(got), None
    timer = threading.Timer(60, con.interrupt)
    timer.start()
    try:
        cur = con.execute(sql)
    finally:
        timer.cancel()
    cols = [d[0] for d in cur.description]
    return took, len(got), compare(df.columns, got, cols, cur.fetchall())


def main(argv):
    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    import __spark_entry__ as entry
    spark, con = session(), connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            took, n, problem = check(name, spark, con, sf, fn, oracle.get(name))
        except Exception as e:
            took, n, problem = 0.0, -1, f"{type(e).__name__}: {str(e)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        flag = "ok " if problem is None else "BAD"
        bad += problem is not None
        print(f"{flag} {name:40s} {took:6.2f}s rows={n} {'' if name in oracle else '(no sql)'} {problem or ''}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
