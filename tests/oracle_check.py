"""Run registered queries beside their SQL on DuckDB and report differences.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{canon(k)}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(row[i]) for i in order) for row in rows)


def compare(df, con, sql, rows=None):
    got = rows_of(df.columns, [tuple(x) for x in (df.collect() if rows is None else rows)])
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    want = rows_of(dcols, cur.fetchall())
    if sorted(df.columns) != sorted(dcols):
        return f"columns differ: {sorted(df.columns)} vs {sorted(dcols)}", len(got)
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} vs {len(want)} rows; spark only {sorted(a - b)[:3]}; sql only {sorted(b - a)[:3]}", len(got)
    return "", len(got)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--partitions", type=int, default=8)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as E
    from radiolake.session import local_session

    spark = local_session(8, args.partitions)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = E.queries(), E.oracle_sql()
    con = duck(args.sf)
    bad = 0
    names = [n for n in queries if not args.names or any(n.startswith(p) for p in args.names)]
    for name in names:
        t, spent = time.time(), 0.0
        try:
            df = queries[name](spark, args.sf)
            if name in sqls:
                rows = df.collect()
                spent = time.time() - t
                diff, n = compare(df, con, sqls[name], rows)
            else:
                diff, n = "", len(df.collect())
                spent = time.time() - t
        except Exception as e:  # noqa: BLE001
            diff, n = f"ERROR {type(e).__name__}: {str(e)[:700]}", -1
        mark = "ok " if not diff else "BAD"
        bad += bool(diff)
        print(f"{mark} {name:10s} rows={n:<7d} {'sql' if name in sqls else '---'} spark {spent:5.1f}s sql {time.time() - t - spent:5.1f}s {diff}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
