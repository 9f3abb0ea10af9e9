"""Run registered queries in Spark and their SQL twins in DuckDB, and compare."""

from __future__ import annotations

import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((x is not None, str(type(x)), str(x)) for x in row)


def compare(spark_rows, spark_cols, sql_rows, sql_cols) -> str:
    """'' when equal; otherwise what differs first."""
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns differ: {sorted(set(spark_cols) ^ set(sql_cols))}"
    order = sorted(spark_cols)
    a = [tuple(r[spark_cols.index(c)] for c in order) for r in spark_rows]
    b = [tuple(r[sql_cols.index(c)] for c in order) for r in sql_rows]
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    def loose(row):
        return tuple(round(x, 4) + 0.0 if isinstance(x, float) and math.isfinite(x) else x for x in row)
    a.sort(key=lambda r: _key(loose(r)))
    b.sort(key=lambda r: _key(loose(r)))
    off, worst, first = 0, 0.0, None
    for x, y in zip(a, b):
        for c, p, q in zip(order, x, y):
            if p != q and not (isinstance(p, float) and isinstance(q, float) and math.isnan(p) and math.isnan(q)):
                off += 1
                if isinstance(p, float) and isinstance(q, float):
                    worst = max(worst, abs(p - q))
                if first is None:
                    first = (c, p, q, x, y)
            elif type(p) is not type(q):
                return f"type of {c}: {type(p).__name__} vs {type(q).__name__}"
    return "" if not off else f"{off} cells differ (max {worst:.3g}), first {str(first)[:600]}"


def check(spark, name, query, text, sf_dir, con=None):
    con = con or duck(sf_dir)
    started = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spark_s = time.time() - started
    if text is None:
        return f"rows-only {len(rows)}", spark_s, 0.0
    started = time.time()
    cur = con.execute(text)
    cols = [c[0] for c in cur.description]
    out = cur.fetchall()
    return compare(rows, df.columns, out, cols) or f"ok {len(rows)}", spark_s, time.time() - started


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    texts = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            verdict, a, b = check(spark, name, query, texts.get(name), sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            verdict, a, b = "ERROR " + str(exc)[:300].replace(chr(10), ' '), 0.0, 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:48s} {a:6.1f}s {b:6.1f}s {verdict}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
