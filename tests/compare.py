"""Run registered queries against their SQL in DuckDB on the same tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(value: object) -> str:
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if type(value).__name__ == "Decimal":
        return str(value.normalize()) if value else "0"
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(name: str, spark, con, folder: str, queries: dict, sql: dict) -> str | None:
    """None when rows, columns and values agree, otherwise what differs."""
    df = queries[name](spark, folder)
    got = df.collect()
    if name not in sql:
        return None if got else "no rows"
    rel = con.execute(sql[name])
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, want)
    if a == b:
        return None if a else "both empty"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} rows vs {len(b)}; only spark {only_a[:2]}; only sql {only_b[:2]}"


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from chronofact.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql, bad = connect(folder), entry.queries(), entry.oracle_sql(), 0
    for name in wanted or queries:
        start = time.time()
        try:
            found = difference(name, spark, con, folder, queries, sql)
        except Exception as error:  # report every query, then fail
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if found is None else found}"
              + ("" if name in sql else " (rows only)"), flush=True)
    print(f"{bad} of {len(wanted or queries)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
