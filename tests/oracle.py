"""Compare queries with their SQL in DuckDB: python -m tests.oracle SF_DIR [NAME...]"""

import glob
import math
import os
import sys
import time
from collections import Counter


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, query, sql):
    """None if rows agree, else what differs."""
    df = query(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = bag(rows, df.columns), bag(got.fetchall(), names)
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    con, bad = duck(sf), 0
    for name, sql in entry.oracle_sql().items():
        if names and name not in names or not names and name.startswith("op"):
            continue
        t = time.time()
        try:
            found = compare(spark, con, sf, entry.queries()[name], sql)
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:500]}"
        bad += found is not None
        print(f"{name} {time.time() - t:.1f} s", found or "ok", flush=True)
    print("failed:", bad)
