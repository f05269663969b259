"""Runs registered queries and their SQL side by side and compares schema kinds and rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return str(value.normalize())
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


# Engine type name -> kind compared between the engines.
KINDS = {
    "tinyint": "int1", "smallint": "int2", "int": "int4", "integer": "int4", "bigint": "int8",
    "hugeint": "int16", "float": "f4", "double": "f8", "string": "text", "varchar": "text",
    "boolean": "bool", "date": "date", "timestamp_ntz": "ts", "timestamp": "ts", "timestamp_ns": "ts",
}


def kind(name: str) -> str:
    name = name.lower()
    return KINDS.get(name, name.replace(" ", ""))


def compare(spark, con, folder: str, build, sql: str) -> list[str]:
    df = build(spark, folder)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} / {sorted(rel.columns)}"]
    types = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    sql_types = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types, strict=True)}
    for n in types:
        if types[n] != sql_types[n]:
            problems.append(f"type of {n}: {types[n]} / {sql_types[n]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    elif got != want:
        bad = next(i for i in range(len(got)) if got[i] != want[i])
        problems.append(f"row {bad}: {got[bad]} / {want[bad]}")
    if not want:
        problems.append("no rows")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from tablewright.plans.all import QUERIES, SQL
    from tablewright.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problems = compare(spark, con, folder, QUERIES[name], SQL[name]) if name in SQL else [
                f"no sql, {QUERIES[name](spark, folder).count()} rows"
            ]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok'}  {name}  {time.time() - start:.2f}s  {problems or ''}")
    print(f"{len(names) - failed} of {len(names)} match")
