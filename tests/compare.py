"""Run registered queries beside their SQL on DuckDB: ``python -m tests.compare [sf_dir] [name …]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

TYPES = {"BOOLEAN": "boolean", "VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{Path(sf_dir) / name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    spark_columns, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    duck_columns, duck_rows = rows_of([d[0] for d in result.description], result.fetchall())
    if spark_columns != duck_columns:
        return f"columns {spark_columns} != {duck_columns}"
    if spark_rows != duck_rows:
        only_spark = list((spark_rows - duck_rows).elements())
        only_duck = list((duck_rows - spark_rows).elements())
        return (
            f"{spark_rows.total()} vs {duck_rows.total()} rows, {len(only_spark)} only in Spark {only_spark[:3]}, "
            f"{len(only_duck)} only in SQL {only_duck[:3]} columns {spark_columns}"
        )
    spark_types = {c: t for c, t in df.dtypes}
    duck_types = {d[0]: TYPES.get(str(d[1]).upper(), str(d[1])) for d in result.description}
    different = {c: (spark_types[c], duck_types[c]) for c in spark_columns if spark_types[c] != duck_types[c]}
    return f"types differ: {different}" if different else None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as entry
    from seatwise.workspace import close
    from tests.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), duck(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            problem = compare(df, con, oracles[name]) if name in oracles else None
            note = "" if name in oracles else f"rows only: {df.count()}"
        except Exception as error:  # report and go on
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {note} {problem or ''}", flush=True)
    close(spark)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
