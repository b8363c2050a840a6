"""Run registered queries against their SQL text in DuckDB and report differences.

    python tests/compare.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if v != v else f"{round(v, 5) + 0.0:.5f}"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "rows-only", len(got), t1 - t0, 0.0, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    a, b = rows_of(df.columns, got), rows_of(names, want)
    detail = ""
    ok = sorted(df.columns) == sorted(names) and a == b
    if not ok:
        if sorted(df.columns) != sorted(names):
            detail = f"columns {sorted(df.columns)} != {sorted(names)}"
        else:
            sa, sb = set(a), set(b)
            detail = f"rows {len(a)} vs {len(b)}; spark-only {len(sa - sb)}, sql-only {len(sb - sa)}\n  cols {sorted(names)}"
            detail += "".join(f"\n  S {x}" for x in sorted(sa - sb)[:3]) + "".join(f"\n  D {x}" for x in sorted(sb - sa)[:3])
    return ("ok" if ok else "DIFF"), len(got), t1 - t0, t2 - t1, detail


def main():
    import __spark_entry__ as entry
    from tests.session import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = make_session()
    con = duck(folder)
    qs, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, n, ts, td, detail = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as e:  # report and go on: this is a survey of all queries
            status, n, ts, td, detail = "ERROR", 0, 0.0, 0.0, str(e)[:1500]
        if status in ("DIFF", "ERROR"):
            bad += 1
        print(f"{status:9} {name:40} rows={n:<7} spark={ts:6.2f}s sql={td:6.2f}s {detail}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
