"""Runs a registered query and its SQL check side by side."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, (list, tuple)):
        return [norm(v) for v in value]
    return value if value is None else str(value)


def spark_rows(df):
    cols = sorted(df.columns)
    types = {n: t for n, t in df.dtypes}
    rows = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    return cols, [types[c] for c in cols], rows


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    cols = sorted(names)
    pos = [names.index(c) for c in cols]
    rows = sorted(repr([norm(r[p]) for p in pos]) for r in rel.fetchall())
    return cols, [types[c] for c in cols], rows


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(spark, con, query, sf_dir):
    """None when equal, else a short account of the difference."""
    cols, types, rows = spark_rows(query.run(spark, sf_dir))
    if query.sql is None:
        return None if rows else "no rows"
    dcols, dtypes, drows = duck_rows(con, query.sql)
    if cols != dcols:
        return f"columns {cols} != {dcols}"
    for c, t, d in zip(cols, types, dtypes):
        if KINDS.get(t, t) != d:
            return f"type of {c}: {t} != {d}"
    if len(rows) != len(drows):
        return f"rows {len(rows)} != {len(drows)}"
    if not rows:
        return "empty"
    for a, b in zip(rows, drows):
        if a != b:
            n = len(set(rows) ^ set(drows))
            only = sorted(set(rows) - set(drows))[:3]
            donly = sorted(set(drows) - set(rows))[:3]
            return f"{n} rows differ\n  spark {only}\n  sql   {donly}"
    return None


def session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gradeloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gradeloom-tests-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    """python -m tests.oracle [sf] [name fragment ...]"""
    from gradeloom.plans.registry import all_queries

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    wanted = argv[1:]
    spark, con = session(), duck(sf_dir)
    bad = 0
    for q in all_queries():
        if wanted and not any(w in q.name for w in wanted):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, q, sf_dir)
        except Exception as e:  # a failing query must not hide the others
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        note = "ok" if diff is None else "FAIL " + diff
        if diff is None and q.sql is None:
            note = "ok (rows only)"
        bad += diff is not None
        print(f"{q.name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
