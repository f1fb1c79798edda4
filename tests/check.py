"""Compare registered queries with their SQL in DuckDB: python tests/check.py [sf] [name-substring ...]."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canon(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(canon(r[i]) for i in order) for r in data], key=repr)


FAMILY = {"bigint": "int", "int": "int", "smallint": "int", "string": "str", "double": "dbl", "boolean": "bool"}
DUCK = {"BIGINT": "int", "INTEGER": "int", "VARCHAR": "str", "DOUBLE": "dbl", "BOOLEAN": "bool"}


def compare(spark, reg, folder):
    t0 = time.time()
    df = reg.run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    secs = time.time() - t0
    if reg.sql is None:
        return f"rows-only {len(got)}", secs, len(got) > 0
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    t1 = time.time()
    cur = con.execute(reg.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    osecs = time.time() - t1
    types = {r[0]: r[1] for r in con.execute("DESCRIBE " + reg.sql).fetchall()}
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(names)}", secs, False
    notes = ""
    for f, ty in df.dtypes:
        if FAMILY.get(ty, ty) != DUCK.get(types[f], types[f]):
            notes += f" [type {f}: {ty} vs {types[f]}]"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return f"MISMATCH rows {len(a)} vs {len(b)}; only spark {len(sa - sb)} e.g. {sorted(sa - sb)[:3]}; only sql {len(sb - sa)} e.g. {sorted(sb - sa)[:3]}{notes}", secs, False
    return f"ok {len(a)} (sql {osecs:.1f}s){notes}", secs, len(a) > 0 and not notes


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    pats = sys.argv[2:]
    import __spark_entry__ as e

    spark = session()
    bad = []
    for name, reg in e.registry().items():
        if pats and not any(p == name or p in reg.ids or p == '@' + reg.module for p in pats):
            continue
        try:
            msg, secs, ok = compare(spark, reg, f"/root/testdata/{sf}")
        except Exception as ex:  # noqa: BLE001
            msg, secs, ok = "ERROR " + str(ex).strip()[:700] + "\n" + "".join(traceback.format_tb(ex.__traceback__)[-2:])[-500:], 0, False
        print(f"{'  ' if ok else '!!'} {name:42s} {secs:6.1f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
