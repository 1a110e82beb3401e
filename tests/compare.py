"""Run registered queries against DuckDB on the same Parquet tables and compare all rows.

    python tests/compare.py [sf dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "tinyint": "TINYINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "array<string>": "VARCHAR[]",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, run, sql: str | None, need_rows: bool = True) -> list[str]:
    """Differences between a query and its SQL; empty when they agree. An empty result counts as a
    difference unless ``need_rows`` is off."""
    df = run(spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return [] if sum(got.values()) > 0 else ["no rows"]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(cur.fetchall(), names)
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    described = dict((r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall())
    for c, t in df.dtypes:
        if TYPES.get(t) != described[c]:
            out.append(f"type of {c}: {t} != {described[c]}")
    if need_rows and not want:
        out.append("no rows")
    if got != want:
        out.append(f"rows {sum(got.values())} vs {sum(want.values())}")
        out += [f"  only Spark {r}" for r in list((got - want).keys())[:3]]
        out += [f"  only SQL   {r}" for r in list((want - got).keys())[:3]]
    return out


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    from sensorspark.session import configure

    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false")
    spark = configure(
        builder, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    wanted = [a for a in args if "/" not in a]
    spark, con = session(), connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            diffs = compare(spark, con, sf_dir, run, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            diffs = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(diffs)
        kind = "S" if name in sqls else "R"
        print(f"{'FAIL' if diffs else 'ok  '} {kind} {name} {time.time() - t:.2f}s", flush=True)
        for d in diffs:
            print("     ", d)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
