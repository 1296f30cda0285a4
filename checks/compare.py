"""Runs queries on Spark and their SQL on DuckDB and compares rows: ``python -m checks.compare``."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return repr(v)


# How the two engines name a type.
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = canonical(df.columns, df.collect())
    t1 = time.time()
    if name not in ORACLES:
        return True, f"{len(got[1])} rows, no oracle"
    cur = con.execute(ORACLES[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    note = f"{len(got[1])} rows, spark {t1 - t0:.1f}s, duckdb {time.time() - t1:.1f}s"
    want_types = {d[0]: d[1] for d in con.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    wrong = {c: (t, want_types.get(c)) for c, t in df.dtypes if TYPES[t] != want_types.get(c)}
    if got == want and wrong:
        return False, f"types {wrong}"
    if got == want:
        return True, note
    if got[0] != want[0]:
        return False, f"columns {got[0]} <> {want[0]}"
    extra = sorted(set(got[1]) - set(want[1]))[:2]
    missing = sorted(set(want[1]) - set(got[1]))[:2]
    return False, f"{note}, expected {len(want[1])}\n   only spark: {extra}\n   only sql: {missing}"


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    spark, con, bad = session(), duck(sf_dir), 0
    for name in names or QUERIES:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note[:2500], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
