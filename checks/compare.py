"""Run registered queries beside their SQL in DuckDB and compare rows.

    python -m checks.compare [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time

import duckdb

from checks.registry import ORACLES, QUERIES
from checks.views import Views
from noticelake.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir: str, key: str) -> bool:
    start = time.time()
    try:
        df = QUERIES[key](Views(spark, sf_dir))
        names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    except Exception as e:  # report and go on to the next query
        print(f"ERROR {key}: {str(e)[:1500]}", flush=True)
        return False
    took = time.time() - start
    if key not in ORACLES:
        print(f"ROWS  {key}: {len(got)} rows, {took:.1f}s", flush=True)
        return bool(got)
    start = time.time()
    try:
        cur = con.execute(ORACLES[key])
        wnames, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    except Exception as e:
        print(f"SQL   {key}: {str(e)[:1500]}", flush=True)
        return False
    sql_took = time.time() - start
    if names != wnames:
        print(f"DIFF  {key}: columns {names} vs {wnames}")
        return False
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        print(f"DIFF  {key}: {len(got)} vs {len(want)} rows; {len(a)} only here, {len(b)} only there {names}")
        for r in sorted(a)[:3]:
            print("   here ", str(r)[:220])
        for r in sorted(b)[:3]:
            print("   there", str(r)[:220])
        sys.stdout.flush()
        return False
    flag = "OK   " if got else "EMPTY"
    print(f"{flag} {key}: {len(got)} rows, {took:.1f}s (sql {sql_took:.1f}s)", flush=True)
    return bool(got)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("keys", nargs="*")
    args = p.parse_args()
    import checks.catalog  # noqa: F401

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session("8")
    con = connect(sf_dir)
    keys = [k for k in QUERIES if not args.keys or any(k == a or k.startswith(a.rstrip("*")) and a.endswith("*") for a in args.keys)]
    bad = [k for k in keys if not check(spark, con, sf_dir, k)]
    print(f"{len(keys) - len(bad)} of {len(keys)} fine; not: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
