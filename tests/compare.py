"""Run registered queries against their SQL: ``python tests/compare.py [folder] [names…]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value) if hasattr(value, "isoformat") else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(frame, connection, sql: str) -> str | None:
    """None when both sides agree on columns, types and rows; else what differs."""
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    kinds = {d[0]: str(d[1]) for d in answer.description}
    right = answer.fetchall()
    left = [tuple(r) for r in frame.collect()]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    for column, kind in frame.dtypes:
        if _KINDS.get(kind, kind) != kinds[column]:
            return f"type of {column}: {kind} != {kinds[column]}"
    a, b = _rows(frame.columns, left), _rows(names, right)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return None if a else "no rows on either side"


def main() -> None:
    import __spark_entry__ as entry_points

    from sluice.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = set(sys.argv[2:])
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    sql = entry_points.oracle_sql()
    bad = 0
    for name, query in entry_points.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            frame = query(spark, folder)
            if name in sql:
                problem = compare(frame, connection, sql[name])
                label = "ok" if problem is None else f"DIFF {problem[:400]}"
            else:
                label = f"rows {frame.count()}"
                problem = None
        except Exception as error:  # noqa: BLE001
            problem = label = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - started:6.2f}s {label}", flush=True)
    print("bad:", bad, "missing:", sorted(set(sql) - set(entry_points.queries())))
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
