"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def canon(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records")]
    rows.sort(key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))
    return cols, rows


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> tuple[bool, str]:
    sc, sr = canon(spark_df)
    dc, dr = canon(duck_df)
    if sc != dc:
        return False, f"columns differ: {sc} vs {dc}"
    if len(sr) != len(dr):
        return False, f"rows differ: spark {len(sr)} vs duck {len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            return False, f"first diff:\n  spark {a}\n  duck  {b}"
    return True, f"{len(sr)} rows"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from textlab.session import get_spark
    spark = get_spark("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"ROWS {name}: {len(sdf)} rows (no oracle) spark {t1 - t0:.1f}s")
            continue
        try:
            ddf = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        ok, msg = compare(sdf, ddf)
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg} spark {t1 - t0:.1f}s duck {time.time() - t1:.1f}s")
        bad += 0 if ok else 1
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
