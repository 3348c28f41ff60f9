"""Runs registered queries against their DuckDB statements and compares whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> tuple[bool, str]:
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(oracles[name])
    types = [d[1] for d in cur.description]
    want_columns, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    note = f"{sum(got.values())} rows, {t1 - t0:.1f}s / {t2 - t1:.1f}s"
    odd = [t for t in types if str(t) in ("HUGEINT", "INTEGER") or str(t).startswith("DECIMAL")]
    if odd:
        note += f" TYPES {odd}"
    if got_columns != want_columns:
        return False, f"{note} columns {got_columns} <> {want_columns}"
    if got != want:
        only_got, only_want = list((got - want).items())[:3], list((want - got).items())[:3]
        return False, f"{note}; {sum((got - want).values())} / {sum((want - got).values())} differ\n   spark {only_got}\n   duck  {only_want}"
    if not got:
        return False, note + " EMPTY"
    return True, note


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from clausetrail import build_session

    sf_dir = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.01")
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in queries:
        if wanted and not any(w in name for w in wanted):
            continue
        if name not in oracles:
            t = time.time()
            print("----", name, len(queries[name](spark, sf_dir).collect()), "rows, no statement", round(time.time() - t, 1), flush=True)
            continue
        try:
            good, note = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as e:
            good, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if good else "FAIL", name, note, flush=True)
    missing = [n for n in oracles if n not in queries]
    if missing:
        print("statements without query:", missing)


if __name__ == "__main__":
    main()
