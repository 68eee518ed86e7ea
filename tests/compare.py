"""Run registered queries beside their SQL in DuckDB and compare the rows.

Usage: python tests/compare.py SF_DIR [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def table(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def type_family(name: str) -> str:
    return {"bigint": "i8", "int": "i4", "double": "f8", "string": "s", "boolean": "b", "date": "d", "timestamp": "t",
            "BIGINT": "i8", "INTEGER": "i4", "DOUBLE": "f8", "VARCHAR": "s", "BOOLEAN": "b"}.get(name, name)


def compare(spark, con, sf_dir: str, name: str, entry) -> tuple[bool, str]:
    start = time.time()
    df = entry.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if entry.sql is None:
        return True, f"rows={len(got)} {took:.1f}s no-sql"
    start = time.time()
    rel = con.execute(entry.sql)
    cols = [d[0] for d in rel.description]
    types = {d[0]: type_family(str(d[1])) for d in rel.description}
    want = rel.fetchall()
    duck = time.time() - start
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    mine = {c: type_family(t) for c, t in df.dtypes}
    a, b = table(df.columns, got), table(cols, want)
    note = "" if mine == types else " TYPES " + str({c: (mine[c], types[c]) for c in mine if mine[c] != types[c]})
    if a == b and not note:
        return True, f"rows={len(a)} {took:.1f}s duck={duck:.1f}s" + (" EMPTY" if not a else "")
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return False, f"rows {len(a)} vs {len(b)}{note} {sorted(cols)} first diffs {diff}"


def make_spark(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from quorumlens.plans import all_queries

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = make_spark(), connect(sf_dir)
    bad = 0
    for name, entry in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, entry)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
