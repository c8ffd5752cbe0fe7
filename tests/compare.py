"""Run registered queries against their SQL twins in DuckDB: python tools_check.py [sf] [name prefix ...]"""

from __future__ import annotations

import datetime
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(rows, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr)


def check(name, spark, con, sf_dir, queries, oracles):
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    a = rows_of([r.asDict() for r in df.collect()], cols)
    t1 = time.time() - t0
    if name not in oracles:
        return f"rows-only {len(a)}", t1, bool(a)
    t0 = time.time()
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    b = rows_of([dict(zip(names, r)) for r in cur.fetchall()], cols) if sorted(names) == cols else None
    t2 = time.time() - t0
    if b is None:
        return f"COLUMNS {sorted(names)} vs {cols}", t1, False
    if a == b:
        nulls = [c for i, c in enumerate(cols) if a and all(r[i] is None for r in a)]
        note = (" EMPTY" if not a else "") + (f" ALLNULL {nulls}" if nulls else "")
        return f"ok {len(a)} duck={t2:.2f}{note}", t1, True
    only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    diff = sorted({cols[i] for x, y in zip(a, b) for i in range(len(cols)) if x[i] != y[i]})
    return f"MISMATCH spark={len(a)} duck={len(b)} differing={diff}\n   cols  {cols}\n   spark {only_a}\n   duck  {only_b}", t1, False


def main():
    import __spark_entry__ as e
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries, oracles = e.queries(), e.oracle_sql()
    bad = []
    for name in queries:
        if sys.argv[2:] and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        try:
            msg, sec, ok = check(name, spark, con, sf_dir, queries, oracles)
        except Exception as ex:  # report and go on with the next query
            msg, sec, ok = f"ERROR {type(ex).__name__}: {str(ex)[:900]}", 0.0, False
        if not ok:
            bad.append(name)
        print(f"{'  ' if ok else '!!'} {name:42s} {sec:6.2f}s {msg}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
