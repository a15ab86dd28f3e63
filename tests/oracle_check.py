"""Run registered queries in Spark and their DuckDB twins; compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]

Compares row count, column names, and the multiset of rows (doubles rounded to
9 significant places, which absorbs only last-bit differences).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from pairfeat.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict[str, str]:
    from __spark_entry__ import oracle_sql, queries
    qs, sql = queries(), oracle_sql()
    con = duck(sf_dir)
    result = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            sp = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            result[name] = f"SPARK-ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, result[name], flush=True)
            continue
        t1 = time.time()
        if name not in sql:
            result[name] = f"rows-only {len(sp)}"
            print(f"{name:28s} {result[name]}  spark {t1 - t0:.1f}s", flush=True)
            continue
        try:
            dk = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            result[name] = f"DUCK-ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, result[name], flush=True)
            continue
        t2 = time.time()
        msg = []
        if sorted(sp.columns) != sorted(dk.columns):
            msg.append(f"cols spark-only={sorted(set(sp.columns) - set(dk.columns))} "
                       f"duck-only={sorted(set(dk.columns) - set(sp.columns))}")
        if len(sp) != len(dk):
            msg.append(f"rows {len(sp)} vs {len(dk)}")
        if not msg:
            a, b = rows(sp), rows(dk)
            bad = [(x, y) for x, y in zip(a, b) if x != y]
            if bad:
                cols = sorted(sp.columns)
                x, y = bad[0]
                diff = [(c, u, v) for c, u, v in zip(cols, x, y) if u != v][:6]
                msg.append(f"{len(bad)} rows differ; first: {diff}")
        result[name] = "OK" if not msg else "; ".join(msg)
        print(f"{name:28s} {result[name][:400]}  rows={len(sp)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s",
              flush=True)
    return result


if __name__ == "__main__":
    from pairfeat import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[4]", shuffle_partitions=8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v != "OK" and not v.startswith("rows-only")}
    print(f"\n{len(res) - len(bad)}/{len(res)} fine; failing: {sorted(bad)}")
