"""Run registered queries and their SQL side by side and report every difference."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from bizlens.sources.tables import TABLES  # noqa: E402


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, bool):
        return int(value)
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "date": "DATE", "float": "FLOAT"}


def type_difference(df, con, sql: str) -> str:
    """Columns whose type differs between the two engines."""
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return ", ".join(
        f"{name} {kind}/{theirs.get(name)}"
        for name, kind in df.dtypes
        if theirs.get(name) != KINDS.get(kind, kind)
    )


def sql_result(con, sql: str):
    cursor = con.execute(sql)
    return table_of([d[0] for d in cursor.description], cursor.fetchall())


def spark_result(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def difference(ours, theirs) -> str | None:
    """None when equal, bit for bit."""
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} vs {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0][0]} vs {wrong[0][1]}" if wrong else None


def main() -> None:
    import __spark_entry__ as entry
    from bizlens.session import local_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if only and name not in only:
            continue
        begin = time.time()
        try:
            df = build(spark, folder)
            ours = spark_result(df)
            took = time.time() - begin
            begin = time.time()
            verdict = difference(ours, sql_result(con, sql[name])) if name in sql else "rows only"
            sql_took = time.time() - begin
            kinds = type_difference(df, con, sql[name]) if name in sql else ""
        except Exception as error:  # noqa: BLE001
            verdict, took, ours, sql_took = f"ERROR {str(error)[:600]}", 0.0, ([], []), 0.0
            kinds = ""
        ok = verdict is None or verdict == "rows only"
        bad += not ok
        print(
            f"{'ok ' if ok else 'BAD'} {name:26s} {len(ours[1]):8d} rows {took:6.2f}s "
            f"(sql {sql_took:.2f}s) {verdict or ''} {kinds}",
            flush=True,
        )
    print("differences:", bad)


if __name__ == "__main__":
    main()
