"""Runs queries beside their SQL on DuckDB and tells which differ: python tests/compare.py FOLDER [NAME...]"""

import glob
import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "isoformat"):
        return x.isoformat().replace("T00:00:00", "")
    return x if not hasattr(x, "as_tuple") else float(x)


def oracle(folder: str):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def differ(con, df, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} and {rel.columns}"
    cols = sorted(df.columns)
    key = lambda row: str(row)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect()), key=key)
    at = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"{len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, queries, sql = oracle(sys.argv[1]), e.queries(), e.oracle_sql()
    names = sys.argv[2:] or [n for n in queries if not n.startswith("op") and n != "pipeline"]
    bad = 0
    for n in names:
        try:
            why = differ(con, queries[n](spark, sys.argv[1]), sql[n]) if n in sql else "" if queries[n](spark, sys.argv[1]).count() else "no rows"
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:300]}"
        bad += bool(why)
        if why:
            print(n, "-", why[:700], flush=True)
    print(len(names), "queries,", bad, "differ")
