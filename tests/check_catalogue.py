"""Run named queries next to their check SQL in DuckDB and report differences.

    python tests/check_catalogue.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from __spark_entry__ import oracle_sql, queries
from peakloom.session import local_session


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t)
    )


def compare(spark, con, sf_dir, name):
    """None when both agree, else a short text."""
    df = queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return "the plan joins every row with every row"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    want_rel = con.sql(sql)
    columns = list(want_rel.columns)
    want = rows_of(columns, want_rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if not want:
        return "check returns no rows"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} against {len(want)}; only here {len(a)}: {sorted(map(str, a))[:2]}; only check {len(b)}: {sorted(map(str, b))[:2]}"
    return None


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


if __name__ == "__main__":
    folder = sys.argv[1]
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in sys.argv[2:] or list(queries()):
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", bad)
