"""Runs queries and their SQL on the same tables and compares the results."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def normal(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)

    def plain(value):
        if value is None or value is pd.NA or value is pd.NaT or value != value:
            return None
        if isinstance(value, bool):
            return value
        if hasattr(value, "item"):
            value = value.item()
        if isinstance(value, float) and value.is_integer():
            return int(value)
        if hasattr(value, "isoformat"):
            return str(value)[:10]
        return value

    rows = [tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def differences(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(duck_frame.columns)}"
    left, right = normal(spark_frame), normal(duck_frame)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for one, other in zip(left, right):
        if one != other:
            return f"{str(one)[:300]} / {str(other)[:300]}"
    return ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from offermarket.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(queries())
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = queries()[name](spark, folder).toPandas()
            seconds = time.time() - start
            sql = oracle_sql().get(name)
            if sql is None:
                print(f"ROWS {name} {len(got)} {seconds:.1f}s", flush=True)
                continue
            start = time.time()
            wanted = connection.execute(sql).df()
            problem = differences(got, wanted)
            print(f"{'BAD ' if problem else 'ok  '} {name} {len(got)} {seconds:.1f}s duck {time.time()-start:.1f}s {problem}", flush=True)
            bad += bool(problem)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} {str(error)[:600]}", flush=True)
    print("bad:", bad)
