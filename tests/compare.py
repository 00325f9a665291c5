"""Run registered queries next to their SQL: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def normal(arrow: pa.Table):
    """Column types and sorted rows, columns in name order."""
    names = sorted(arrow.column_names)
    types = [str(arrow.schema.field(n).type).replace("large_", "") for n in names]
    columns = [arrow.column(n).to_pylist() for n in names]
    rows = sorted(zip(*columns), key=lambda row: tuple((x is not None, str(x)) for x in row))
    return names, types, rows


def compare(spark, connection, folder, query, sql):
    """None when Spark and SQL agree, else what differs first; and the Spark seconds."""
    started = time.time()
    have = query(spark, folder).toArrow()
    seconds = time.time() - started
    if sql is None:
        return None if have.num_rows else "no rows", seconds, have.num_rows
    want = connection.sql(sql).to_arrow_table()
    a, b = normal(have), normal(want)
    for label, x, y in zip(("columns", "types"), a, b):
        if x != y:
            return f"{label}: {x} / {y}", seconds, have.num_rows
    if not have.num_rows:
        return "no rows", seconds, 0
    if len(a[2]) != len(b[2]):
        return f"rows: {len(a[2])} / {len(b[2])}; {a[2][:2]} / {b[2][:2]}", seconds, have.num_rows
    for x, y in zip(a[2], b[2]):
        if x != y:
            return f"values: {str(x)[:300]} / {str(y)[:300]}", seconds, have.num_rows
    return None, seconds, have.num_rows


def main():
    import __spark_entry__ as entry
    from tidelake.session import build_session, clear_runs

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", conf={
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(folder), entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            problem, seconds, rows = compare(spark, connection, folder, query, sql.get(name))
        except Exception as error:  # report and go on with the next query
            problem, seconds, rows = f"{type(error).__name__}: {str(error)[:600]}", 0.0, 0
        print(f"{'ok  ' if problem is None else 'BAD '} {name:28s} {seconds:6.2f}s {rows:7d} "
              f"{'' if name in sql else '(no SQL) '}{problem or ''}", flush=True)
        if problem:
            bad.append(name)
        clear_runs(spark)
    print("bad:", bad)


if __name__ == "__main__":
    main()
