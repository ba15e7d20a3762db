"""Run one catalog query on Spark and its SQL on DuckDB, and compare all values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(value + 0.0))
    return (type(value).__name__, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, sf_dir: str, run, sql: str, con) -> tuple[int, float, float]:
    started = time.time()
    df = run(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    spark_seconds = time.time() - started
    started = time.time()
    result = con.execute(sql)
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    assert mine[0] == theirs[0], f"columns {mine[0]} != {theirs[0]}"
    assert len(mine[1]) == len(theirs[1]), f"rows {len(mine[1])} != {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    assert not wrong, f"{len(wrong)} of {len(mine[1])} rows differ, first:\n{wrong[0][0][:600]}\n{wrong[0][1][:600]}"
    return len(mine[1]), spark_seconds, time.time() - started


def main(argv: list[str]) -> int:
    """python tests/oracle.py SF_DIR [name ...]"""
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from chartloom.session import build_session
    spark = build_session("local[8]", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(argv[0])
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in argv[1:] or queries:
        try:
            if name in oracles:
                rows, a, b = compare(spark, argv[0], queries[name], oracles[name], con)
            else:
                started = time.time()
                rows, b = len(queries[name](spark, argv[0]).collect()), 0.0
                a = time.time() - started
            print(f"ok   {name:22} {rows:8} rows  spark {a:6.2f}s  duckdb {b:6.2f}s", flush=True)
        except Exception as error:
            failed.append(name)
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:1500]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
