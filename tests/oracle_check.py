"""Run registered queries in Spark and their SQL twins in DuckDB, and compare (as the round driver does).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (np.floating,)):
        return None if np.isnan(v) else float(v)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if v is not None and hasattr(v, "isoformat"):
        return v.isoformat()
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except Exception:
        pass
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, out


def compare(spark_pdf, duck_pdf):
    sc, sr = rows_of(spark_pdf)
    dc, dr = rows_of(duck_pdf)
    if sc != dc:
        return f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return f"row count differs: spark={len(sr)} duck={len(dr)}"
    key = lambda r: tuple((x is None, repr(x)) for x in r)
    sr.sort(key=key)
    dr.sort(key=key)
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first: spark={bad[0][0]!r:.300} duck={bad[0][1]!r:.300}"
    return None


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    import __spark_entry__ as entry
    from textlake.session import local_session

    spark = local_session()
    q, o = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    failures = 0
    for name in names or list(q):
        t0 = time.time()
        try:
            spdf = q[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            failures += 1
            continue
        t1 = time.time()
        if name not in o:
            print(f"ROWS {name}: {len(spdf)} rows, spark {t1 - t0:.1f}s (no oracle)")
            continue
        try:
            dpdf = con.execute(o[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            failures += 1
            continue
        t2 = time.time()
        err = compare(spdf, dpdf)
        if err:
            failures += 1
            print(f"FAIL {name}: {err}")
        else:
            print(f"OK   {name}: {len(spdf)} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s")
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
