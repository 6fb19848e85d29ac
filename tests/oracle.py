"""Run registered queries on Spark and on DuckDB and compare their rows."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(cell(r[n]) for n in names) for r in df.collect()]
    return names, [dict(df.dtypes)[n] for n in names], rows


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(cell(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], [types[i] for i in order], rows


def compare(df, con, sql):
    t0 = time.time()
    n1, t1, r1 = spark_rows(df)
    t1_ = time.time()
    n2, t2, r2 = duck_rows(con, sql)
    print(f"    collect {t1_ - t0:.1f}s duckdb {time.time() - t1_:.1f}s", end=" ")
    problems = []
    if n1 != n2:
        problems.append(f"columns {n1} != {n2}")
    if len(r1) != len(r2):
        problems.append(f"rows {len(r1)} != {len(r2)}")
    left, right = Counter(r1), Counter(r2)
    if left != right:
        a, b = list((left - right).items())[:3], list((right - left).items())[:3]
        problems.append(f"only spark ({sum((left - right).values())}): {a}\n   only duckdb: {b}")
    return len(r1), list(zip(n1, t1, t2)), problems


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    from engram.session import configure

    spark = (
        configure(SparkSession.builder)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sf = os.environ.get("SF", "0.01")
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry

    spark, con = session(), duck(sf_dir)
    bad = 0
    names = list(entry.queries())
    for name in names:
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in entry.oracle_sql():
                n, types, problems = compare(df, con, entry.oracle_sql()[name])
            else:
                n, types, problems = len(df.collect()), "rows only", []
        except Exception as e:  # noqa: BLE001
            n, types, problems = -1, [], [f"{type(e).__name__}: {str(e)[:1800]}"]
        mark = "ok " if not problems else "BAD"
        bad += bool(problems)
        print(f"{mark} {name} rows={n} {time.time() - start:.1f}s", flush=True)
        if problems or os.environ.get("TYPES"):
            print("   ", types)
        for p in problems:
            print("   ", p)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
