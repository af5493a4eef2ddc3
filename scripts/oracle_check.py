"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python scripts/oracle_check.py [sf_dir] [name-substring ...]
Prints one line per query: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from stay_analytics.plans.registry import load_all  # noqa: E402
from stay_analytics.session import local_session  # noqa: E402
from stay_analytics.sources.tables import TABLES  # noqa: E402


def norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return str(v.date()) if v == v.normalize() else str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(norm_value(r[c]) for c in cols) for r in df.to_dict("records")]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    reg = load_all()
    names = [n for n in reg if not args or any(a in n for a in args)]
    spark = local_session(8, 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        q = reg[name]
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            pdf = sdf.toPandas()
            el = time.time() - t0
            if q.oracle is None:
                print(f"ROWS-ONLY {name}: {len(pdf)} rows {el:.1f}s", flush=True)
                continue
            odf = con.sql(q.oracle).df()
            sc, sr = canon(pdf)
            oc, orows = canon(odf)
            if sc != oc:
                bad += 1
                print(f"MISMATCH-COLS {name}: spark={sc} oracle={oc}", flush=True)
                continue
            if sr != orows:
                bad += 1
                diff = [r for r in sr if r not in set(orows)][:3]
                odiff = [r for r in orows if r not in set(sr)][:3]
                print(f"MISMATCH {name}: spark={len(sr)} oracle={len(orows)} {el:.1f}s\n  spark-only {diff}\n"
                      f"  oracle-only {odiff}", flush=True)
                continue
            print(f"OK {name}: {len(sr)} rows {el:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"done: {len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
