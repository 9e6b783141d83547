"""Compare registered queries with their SQL equivalents.

Run as a script: ``python tests/compare.py SF_DIR [query ...]``.
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in data)


def difference(frame, con, statement: str) -> str | None:
    """None when the results agree, else a short description."""
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(statement)
    names = [c[0] for c in result.description]
    want = _rows(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    if got == want:
        return None
    extra, missing = got - want, want - got
    return (
        f"{sum(got.values())} vs {sum(want.values())} rows; {sum(extra.values())} extra"
        f" e.g. {list(extra)[:2]}; {sum(missing.values())} missing e.g. {list(missing)[:2]}"
    )


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    con = connect(sf_dir)
    statements, registered = contract.oracle_sql(), contract.queries()
    bad = 0
    for name in sys.argv[2:] or registered:
        start = time.time()
        try:
            found = difference(registered[name](spark, sf_dir), con, statements[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{name:20s} {time.time() - start:6.2f}s {'ok' if found is None else found[:1500]}", flush=True)
    print(f"{bad} differ; without statement: {sorted(set(registered) - set(statements))}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
