"""python tests/check_oracle.py [NAME...]: each query against its SQL on sf0.01, as the driver compares them."""

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.01"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(round(r[i], 5) if isinstance(r[i], float) else float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in data))


def connect():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def compare(spark, c, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in entry.oracle_sql():
        return f"{len(got)} rows, no SQL"
    told = c.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    want = rows(columns, told.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"DIFFERENT columns {sorted(columns)} {sorted(df.columns)}"
    if got != want:
        only = [x for x in zip(got, want) if x[0] != x[1]][:2]
        return f"DIFFERENT {len(got)} {len(want)} {only}"
    return f"equal, {len(got)} rows"


if __name__ == "__main__":
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    c = connect()
    for name in sys.argv[1:] or [n for n in entry.queries()]:
        began = time.time()
        try:
            print(name, compare(spark, c, name), round(time.time() - began, 1), flush=True)
        except Exception as e:
            print(name, "FAILED", str(e)[:600], flush=True)
