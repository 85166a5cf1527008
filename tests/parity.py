"""Run a registered query on Spark and its SQL on DuckDB and compare rows and types."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPE_NAMES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        source = os.path.join(path, "*.parquet") if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return connection


def _canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_canonical(v) for v in value) + "]"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canonical(r[i]) for i in order) for r in rows)


def compare(frame, relation) -> list[str]:
    problems = []
    spark_rows, duck_rows = frame.collect(), relation.fetchall()
    if sorted(frame.columns) != sorted(relation.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(relation.columns)}"]
    duck_types = {
        c: TYPE_NAMES.get(str(t), str(t).lower()) for c, t in zip(relation.columns, relation.types)
    }
    for name, kind in frame.dtypes:
        if duck_types[name] != kind and "[" not in duck_types[name]:
            problems.append(f"type of {name}: spark {kind}, duckdb {duck_types[name]}")
    left, right = _rows(frame.columns, spark_rows), _rows(list(relation.columns), duck_rows)
    if len(left) != len(right):
        problems.append(f"rows: spark {len(left)}, duckdb {len(right)}")
    if left != right:
        only_spark = [r for r in left if r not in set(right)][:3]
        only_duck = [r for r in right if r not in set(left)][:3]
        problems.append(f"values differ; columns {sorted(frame.columns)}; spark {only_spark}; duckdb {only_duck}")
    return problems


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from lectern.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    connection = duck(folder)
    sql = entry.oracle_sql()
    wanted = sys.argv[1:]
    failed = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            frame = query(spark, folder)
            if name in sql:
                problems = compare(frame, connection.sql(sql[name]))
                count = ""
            else:
                problems, count = [], f"rows-only {frame.count()}"
        except Exception as error:  # noqa: BLE001 - the report names every failing query
            problems, count = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s {count}", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
    print("failed", failed)
