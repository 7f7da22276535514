"""Runs named queries on Spark and their SQL on DuckDB, and compares rows as the driver does: by column name, any order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings memories entities entity_mentions relationships surfaced_memories remember_requests subject_labels eval_items subjects source_targets".split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    import datetime
    import decimal

    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def same(spark, con, name: str, query, sql: str, folder: str) -> str:
    """'' if both agree, else what differs."""
    df = query(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left == right:
        return ""
    if left[0] != right[0]:
        return f"columns {left[0]} and {right[0]}"
    a, b = [r for r in left[1] if r not in set(right[1])][:3], [r for r in right[1] if r not in set(left[1])][:3]
    return f"rows {len(left[1])} and {len(right[1])}; only Spark: {a}; only SQL: {b}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from memlode.runtime import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            said = same(spark, con, name, query, sql[name], folder) if name in sql else f"(no SQL) {query(spark, folder).count()} rows"
        except Exception as error:  # noqa: BLE001
            said = f"ERROR {str(error)[:600]}"
        bad += bool(said) and not said.startswith("(no SQL)")
        print(f"{name}: {said or 'same'} [{time.time() - start:.1f} s]", flush=True)
    print("bad", bad)
