"""Compare every registered query with its SQL twin, as the driver does."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return str(v)
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(cell(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, name, build, sql):
    started = time.time()
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - started
    started = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_s = time.time() - started
    a, left = digest(df.columns, got)
    b, right = digest(names, want)
    same = a == b and sorted(df.columns) == sorted(names)
    detail = ""
    if not same:
        lost = sorted(set(right) - set(left))[:3]
        extra = sorted(set(left) - set(right))[:3]
        detail = f"columns {sorted(df.columns)} / {sorted(names)}; only spark {extra}; only sql {lost}"
    plan = df._jdf.queryExecution().executedPlan().toString()
    return same, len(got), len(want), spark_s, sql_s, detail, plan


if __name__ == "__main__":
    import __spark_entry__ as driver
    from glyphmill.session import local_session

    QUERIES, ORACLES = driver.queries(), driver.oracle_sql()

    folder = sys.argv[1]
    session, con = local_session(8), connect(folder)
    bad = []
    for name in sys.argv[2:] or ORACLES:
        try:
            same, n, m, a, b, detail, _ = compare(session, con, folder, name, QUERIES[name], ORACLES[name])
        except Exception as e:  # keep going, report at the end
            same, n, m, a, b, detail = False, -1, -1, 0, 0, f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if same else 'DIFF'} {name:28s} rows {n}/{m} spark {a:.1f}s sql {b:.1f}s {detail[:1500]}", flush=True)
        if not same:
            bad.append(name)
    print("failed:", bad)
