"""Run named queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sessionloom.plans.oracle import ORACLE  # noqa: E402
from sessionloom.plans.queries import QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def _multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark, connection, sf_dir: str, name: str):
    """(rows, columns that differ, rows only in Spark, rows only in the database)."""
    df = QUERIES[name](spark, sf_dir)
    ours = _multiset(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    theirs = _multiset(columns, cursor.fetchall())
    names = set(df.columns) ^ set(columns)
    return sum(ours.values()), names, ours - theirs, theirs - ours


if __name__ == "__main__":
    from sessionloom.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = database(folder)
    for query_name in chosen:
        started = time.time()
        try:
            if query_name not in ORACLE:
                print(f"ROWS {query_name} {QUERIES[query_name](spark, folder).count()} {time.time() - started:.1f}s", flush=True)
                continue
            n, names, left, right = differences(spark, db, folder, query_name)
            verdict = "OK  " if not (names or left or right) else "DIFF"
            print(f"{verdict} {query_name} rows={n} {time.time() - started:.1f}s", flush=True)
            if verdict == "DIFF":
                print("   columns", names, "| spark only", sum(left.values()), list(left)[:2], "| sql only", sum(right.values()), list(right)[:2], flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {query_name} {str(error)[:700]}", flush=True)
