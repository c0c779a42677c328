"""Local stand-in for the driver's check: Spark query vs DuckDB oracle SQL.

Compares row count, column names and an order-insensitive hash of the values.
Usage: python tests/oracle_harness.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v) -> str:
    if v is None:
        return "NULL"
    try:
        if isinstance(v, float) and math.isnan(v):
            return "NULL"
    except TypeError:
        pass
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return str(int(f)) if f.is_integer() else f"{f:.9g}"
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, _dt.datetime) else v.isoformat()
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().isoformat(sep=" ")
    return str(v)


def digest(rows, cols) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(canon(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, key, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t
    if sql is None:
        return {"key": key, "rows": len(s_rows), "oracle": None, "spark_s": round(ts, 2)}
    res = con.sql(sql)
    d_cols = res.columns
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    hs, hd = digest(s_rows, s_cols), digest(d_rows, d_cols)
    return {
        "key": key, "rows": len(s_rows), "oracle_rows": len(d_rows), "cols_ok": ok_cols,
        "match": ok_cols and ok_n and hs == hd, "spark_s": round(ts, 2),
        **({} if ok_cols else {"spark_cols": s_cols, "oracle_cols": d_cols}),
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from matchfold.session import build_session

    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for key in keys or list(qs):
        try:
            r = compare(spark, con, key, qs[key], oracle.get(key), sf_dir)
        except Exception as e:  # report and continue
            r = {"key": key, "error": f"{type(e).__name__}: {str(e)[:300]}"}
        if not r.get("match", r.get("oracle", 1) is None and "error" not in r):
            bad += 1
        print(r, flush=True)
    print("mismatches:", bad)


if __name__ == "__main__":
    main(sys.argv)
