"""Run registered queries in Spark and their SQL in DuckDB and compare whole results by value."""
from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("-0.0" if v == 0 and math.copysign(1, v) < 0 else repr(v))
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: [str(x) for x in r])


def compare(spark, con, folder, name, build, statement):
    t0 = time.time()
    df = build(spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if statement is None:
        return True, f"{len(got)} rows, no SQL, {t1 - t0:.1f}s"
    cur = con.execute(statement)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = normal(got, df.columns), normal(want, cols)
    if len(a) != len(b):
        return False, note + f" ROWS {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, note + f" DIFF {len(bad)}: {bad[0][0]} vs {bad[0][1]}"
    return True, note


def main(argv):
    import os
    from barloom.session import build_session
    import __spark_entry__ as entry

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in queries:
        if argv and not any(a in name if not a.startswith("=") else a[1:] == name for a in argv):
            continue
        try:
            ok, note = compare(spark, con, folder, name, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
