"""Run registered queries beside their SQL twins and compare strictly.

``python tests/oracle.py [sf_dir] [name-prefix ...]``
"""

from __future__ import annotations

import math
import os
import sys
import threading
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LIMIT = 75.0
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        if math.isnan(value):
            return "f:nan"
        return f"f:{value!r}"
    return f"{type(value).__name__}:{value}"


def shape(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """Return (ok, message)."""
    rows = [tuple(r) for r in df.collect()]
    cols, got = shape(df.columns, rows)
    cur = con.execute(sql)
    want_cols, want = shape([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return False, f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; first {got[:2]} | {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, columns {cols}\n      got  {bad[0][0]}\n      want {bad[0][1]}"
    return True, f"{len(got)} rows"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    import __spark_entry__ as entry_module

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = session(), connect(sf_dir)
    sqls, failed = entry_module.oracle_sql(), []
    for name, run in entry_module.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        watch = threading.Timer(LIMIT, lambda n=name: (print(f"HUNG {n}", flush=True), os._exit(9)))
        watch.start()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                ok, message = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                ok, message = True, f"{n} rows (no SQL)"
                if n == 0:
                    ok, message = False, "no rows"
            if message.startswith("0 rows"):
                message += "  <-- EMPTY"
        except Exception as error:  # report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        watch.cancel()
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} {time.time() - start:6.2f}s {message}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
