"""Compare registered queries with their SQL twins: `python tests/oracle.py [sf] [name …]`."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


# Spark type names beside what the SQL side calls them.
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def difference(df, con, sql: str) -> str | None:
    """Nothing if both sides agree, else what is different."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    for field in df.schema.fields:
        if KINDS.get(field.dataType.simpleString()) != kinds[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} and {kinds[field.name]}"
    theirs = _rows(columns, result.fetchall())
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{sorted(columns)}: {a} and {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    con = connect(sf_dir)
    failed = 0
    for name, query in queries().items():
        if name not in oracle_sql() or len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            problem = difference(df, con, oracle_sql()[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
