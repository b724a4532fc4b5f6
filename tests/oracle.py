"""Runs a query and its SQL over one folder of tables and compares the rows."""

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings csf_table conversion_stats csf_raw descriptor_raw descriptor_copy descriptor_norm subshell_meta peel eval_items".split()


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connection(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def expected(sf, sql):
    con = connection(sf)
    con.execute(sql)
    return [d[0] for d in con.description], con.fetchall()


def agree(spark, sf, query, sql):
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    names, rows = expected(sf, sql)
    want = rows_of(names, rows)
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    return got, want


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, only = sys.argv[1], sys.argv[2:]
    for name, q in e.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            if name in e.oracle_sql():
                got, want = agree(spark, sf, q, e.oracle_sql()[name])
                print(name, "ok" if got == want else f"DIFFERS only spark {sum((got - want).values())} {list((got - want))[:2]} only sql {sum((want - got).values())} {list((want - got))[:2]}", sum(got.values()), f"{time.time() - t0:.1f}s", flush=True)
            else:
                print(name, "rows", q(spark, sf).count(), f"{time.time() - t0:.1f}s", flush=True)
        except Exception as x:
            print(name, "ERROR", str(x)[:1500], flush=True)
