"""Run named queries beside their SQL on DuckDB and compare the results.

    python tools/compare.py [folder] [name ...]
"""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return str(value).replace("+00:00", "")
    return value


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in data), key=repr)


FAMILY = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "HUGEINT": "hugeint", "DATE": "date", "FLOAT": "float",
}


def compare(spark, con, name, query, sql, folder):
    """(ok, rows, message)"""
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return bool(mine), len(mine), "rows only"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: FAMILY.get(str(d[1]), str(d[1])) for d in cur.description}
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, len(mine), f"columns {sorted(df.columns)} against {sorted(names)}"
    off = {f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema if f.dataType.simpleString() != types[f.name]}
    if off:
        return False, len(mine), f"types (spark, sql): {off}"
    if mine != theirs:
        extra, lack = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
        return False, len(mine), f"{len(mine)} against {len(theirs)} rows; only spark {extra}; only sql {lack}"
    return bool(mine), len(mine), "equal" if mine else "EMPTY"


def main():
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    entry = importlib.import_module("__spark_entry__")
    from corpuswarden.session import get_session

    spark = get_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(folder), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            ok, n, note = compare(spark, con, name, queries[name], oracle.get(name), folder)
        except Exception as problem:  # report and go on with the next query
            ok, n, note = False, -1, f"{type(problem).__name__}: {str(problem)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {n:8d} rows {time.time() - start:6.1f}s {note if not ok or note != 'equal' else ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
