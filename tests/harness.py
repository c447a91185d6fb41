"""Spark-vs-DuckDB oracle comparison (mirrors the correctness gate).

    python -m tests.harness [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from chainscope.sources.fixtures import DRIVER_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark_df, con, sql):
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}")
        return problems, len(srows), len(drows)
    if len(srows) != len(drows):
        problems.append(f"row count spark={len(srows)} duck={len(drows)}")
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a != b:
        sa, sb = set(a), set(b)
        only_s, only_d = list(sa - sb)[:3], list(sb - sa)[:3]
        problems.append(f"values differ; spark-only={only_s} duck-only={only_d}")
    return problems, len(srows), len(drows)


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from chainscope.session import get_spark
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = get_spark("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t = time.time()
        if name not in os_:
            n = qs[name](spark, sf_dir).count()
            print(f"{name:28s} rows-only  {n:8d}  {time.time()-t:6.1f}s", flush=True)
            continue
        try:
            problems, ns, nd = compare(qs[name](spark, sf_dir), con, os_[name])
        except Exception as e:  # noqa: BLE001
            problems, ns, nd = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], -1, -1
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{name:28s} {status} spark={ns:7d} duck={nd:7d} {time.time()-t:6.1f}s", flush=True)
        for p in problems:
            print("    ", p[:1500], flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
