"""Run queries beside their SQL and compare the rows.

    python tests/checker.py [--sf 0.01] [prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, datetime.datetime):
        v = v.date() if v.time() == datetime.time() else v
    if isinstance(v, (int, float)):
        return (2, repr(float(v) + 0.0))
    return (3, str(v))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return normal(columns, cur.fetchall())


def difference(got, want) -> str | None:
    """None when equal, else a short account."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    off = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(off)} of {len(got[1])} rows differ, e.g. {off[0]}" if off else None


def session(partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("prefix", nargs="*")
    opts = args.parse_args()
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{opts.sf}"
    sqls, con, spark, bad = entry.oracle_sql(), connect(sf_dir), session(), []
    for name, fn in entry.queries().items():
        if opts.prefix and not any(name.startswith(p) for p in opts.prefix):
            continue
        try:
            t0 = time.time()
            got = spark_rows(fn(spark, sf_dir))
            t1 = time.time()
            want = duck_rows(con, sqls[name]) if name in sqls else None
            t2 = time.time()
            note = difference(got, want) if want else None
            state = "ok " if not note and want else ("rows" if not note else "BAD")
            print(f"{state} {name} {len(got[1])} rows, {t1 - t0:.2f}s (sql {t2 - t1:.2f}s) {note or ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
            print(f"ERR {name} {note}", flush=True)
        if note:
            bad.append(name)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
