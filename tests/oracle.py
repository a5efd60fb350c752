"""Run a registered query and its SQL counterpart, and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, job, sql):
    """None when equal, else a short description of the difference."""
    t0 = time.time()
    df = job(spark, sf)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return None, len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}", len(got), t1 - t0, t2 - t1
    a, b = _rows(df.columns, got), _rows(cols, want)
    if a == b:
        return None, len(got), t1 - t0, t2 - t1
    sa, sb = set(a), set(b)
    left = [x for x in a if x not in sb][:2]
    right = [x for x in b if x not in sa][:2]
    return f"rows {len(a)} against {len(b)}; only here {left}; only there {right}", len(got), t1 - t0, t2 - t1


def main(argv):
    import __spark_entry__ as entry
    from sheafline.session import local_session

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, job in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            diff, n, spark_s, duck_s = compare(spark, con, sf, name, job, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            diff, n, spark_s, duck_s = f"{type(e).__name__}: {str(e)[:600]}", -1, 0, 0
        kind = "S" if name in oracles else "R"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {kind} {name:26s} {n:8d} rows {spark_s:6.2f}s {duck_s:6.2f}s {'' if diff is None else diff[:900]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv)
