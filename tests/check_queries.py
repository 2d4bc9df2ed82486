"""Run registered queries beside their check SQL: `python tests/check_queries.py [-d DIR] [name part …]`."""

from __future__ import annotations

import argparse
import decimal
import glob
import hashlib
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value) -> str:
    if value is None or value != value:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def duck(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def compare(spark, connection, build, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    frame = build(spark, sf_dir)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return True, f"{len(got)} rows, no check SQL"
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = canonical(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if got == want:
        digest = hashlib.md5(repr(got).encode()).hexdigest()[:8]
        return True, f"{len(got)} rows {digest}"
    missing, extra = sorted(set(want) - set(got))[:2], sorted(set(got) - set(want))[:2]
    return False, f"{len(got)} rows, wanted {len(want)}; missing {missing}; extra {extra}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    args = parser.parse_args()

    import __spark_entry__ as entry
    from dialoglens.session import build_session

    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(args.d)
    checks, bad, started = entry.oracle_sql(), [], time.time()
    for name, build in entry.queries().items():
        if args.names and not any(part in name for part in args.names):
            continue
        begin = time.time()
        try:
            ok, note = compare(spark, connection, build, checks.get(name), args.d)
        except Exception as problem:
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:600]}"
            if args.names:
                traceback.print_exc()
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - begin:.2f}s {note}", flush=True)
    print(f"{len(bad)} bad {bad} in {time.time() - started:.0f}s")


if __name__ == "__main__":
    main()
