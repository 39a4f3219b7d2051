"""Compare registered queries with DuckDB running their oracle SQL on the same tables.

    python -m tests.oracle [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

# Spark type to the DuckDB types that hold the same values.
SAME_TYPE = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL result; empty if nothing does."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(set(df.columns) ^ set(names))}"]
    out = [
        f"type of {f.name}: {f.dataType.simpleString()} against {types[f.name]}"
        for f in df.schema.fields
        if types[f.name] not in SAME_TYPE.get(f.dataType.simpleString(), set())
    ]
    want = sorted_rows(names, result.fetchall())
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        out.append(f"{len(got)} rows, expected {len(want)}")
    unequal = [(g, w) for g, w in zip(got, want) if g != w]
    if unequal:
        out.append(f"{len(unequal)} unequal rows, first: got {unequal[0][0]} want {unequal[0][1]}")
    return out


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if name not in oracle or len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            found = differences(query(spark, sf_dir), con, oracle[name])
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - started:.2f}s", flush=True)
        for line in found:
            print("     ", line[:900], flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
