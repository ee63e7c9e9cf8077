"""python tests/oracle.py SF_DIR [NAME...]: runs queries beside their DuckDB SQL and compares the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(r[i] for i in order)) for r in data)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(sf_dir).execute(sql)
    b = rows([c[0] for c in rel.description], rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} against {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} rows against {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(bad)} of {len(a[1])} rows differ, as {bad[:2]}" if bad else ""


if __name__ == "__main__":
    sys.path[:0] = [str(Path(__file__).resolve().parent.parent)]
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            said = compare(spark, sys.argv[1], q[name], o[name]) if name in o else f"{q[name](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
