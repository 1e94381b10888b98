"""Run registered queries next to their SQL statements and compare the rows.

usage: python tools/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(pdf):
    import pandas as pd
    pdf = pdf[sorted(pdf.columns)]
    out = []
    for rec in pdf.itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NA or v != v else
                         f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
                         for v in rec))
    return sorted(out)


def differences(spark, con, name, sf_dir):
    """(message or None, row count, spark seconds, sql seconds)."""
    from lumenframe.plans import ORACLES, QUERIES
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    t1 = time.time()
    if name not in ORACLES:
        return None, len(got), t1 - t0, 0.0
    want = con.execute(ORACLES[name]).fetchdf()
    t2 = time.time()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", len(got), t1 - t0, t2 - t1
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got), t1 - t0, t2 - t1
    a, b = rows(got), rows(want)
    bad = [(p, q) for p, q in zip(a, b) if p != q]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", len(got), t1 - t0, t2 - t1
    for c in got.columns:
        if got[c].dtype.kind != want[c].dtype.kind:
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}", len(got), t1 - t0, t2 - t1
    return None, len(got), t1 - t0, t2 - t1


def main():
    from lumenframe.plans import ORACLES, QUERIES
    from lumenframe.session import local_session
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        try:
            msg, n, a, b = differences(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            msg, n, a, b = f"{type(e).__name__}: {str(e)[:600]}", -1, 0, 0
        failed += msg is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if msg else 'ok':4} {name:28} {kind:4} n={n} spark={a:.2f}s sql={b:.2f}s {msg or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
