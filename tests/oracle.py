"""Compare registered queries with their SQL: ``python -m tests.oracle [--sf DIR] [name ...]``."""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from queries.base import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v: object) -> object:
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def rows_of(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


KINDS = (("int", ("BIGINT", "INTEGER", "SMALLINT", "TINYINT", "bigint", "int", "smallint", "tinyint")), ("float", ("DOUBLE", "FLOAT", "double", "float")), ("text", ("VARCHAR", "string")), ("bool", ("BOOLEAN", "boolean")), ("time", ("TIMESTAMP", "timestamp_ntz", "timestamp")), ("date", ("DATE", "date")))


def kind(t: str) -> str:
    t = t.split("(")[0]
    return next((k for k, names in KINDS if t in names), t.lower())


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:  # noqa: ANN001
    """None if both agree, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: kind(str(d[1])) for d in rel.description}
    want = rows_of(names, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    for n, t in df.dtypes:
        if kind(t) != types[n]:
            return f"type of {n}: {t} != {types[n]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{got[0]}\n  spark {a}\n  sql   {b}"
    return None if got[1] else "EMPTY"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from changefeed.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("check", 8, **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sql, bad = connect(args.sf), queries(), oracle_sql(), 0
    for name, fn in qs.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, fn, sql[name], args.sf) if name in sql else f"(no sql) rows {fn(spark, args.sf).count()}"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        if problem and not problem.startswith("(no sql)"):
            bad += 1
        print(f"{'ok ' if problem is None else '** '} {name} {time.time() - t:.2f}s {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main())
