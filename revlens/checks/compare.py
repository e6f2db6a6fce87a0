"""Run a Spark query and its DuckDB oracle side by side and compare results.

Used by tests and by ``python -m revlens.checks.compare``; compares row count,
column names and an order-insensitive hash of normalised values.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import math
import os
import sys
import time

import pandas as pd

from ..sources.tables import TABLES, table_path


def duckdb_conn(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        if isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) + 0.0
    if isinstance(v, (pd.Timestamp, _dt.datetime)):
        return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) is None \
            else pd.Timestamp(v).tz_convert("UTC").tz_localize(None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def _canon(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm(v) for v in rec))
    return cols, rows


def digest(rows: list[tuple]) -> str:
    hs = sorted(hashlib.sha1(repr(r).encode()).hexdigest() for r in rows)
    return hashlib.sha1("".join(hs).encode()).hexdigest()


def spark_rows(df) -> pd.DataFrame:
    rows = df.collect()
    return pd.DataFrame([r.asDict(recursive=True) for r in rows], columns=df.columns)


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    sp = spark_rows(sdf)
    t1 = time.time()
    out = {"name": name, "spark_rows": len(sp), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "no-oracle"
        return out
    con = con or duckdb_conn(sf_dir)
    dd = con.execute(sql).df()
    out["duck_sec"] = round(time.time() - t1, 2)
    out["duck_rows"] = len(dd)
    sc, sr = _canon(sp)
    dc, dr = _canon(dd)
    out["cols_match"] = sc == dc
    if sc != dc:
        out["spark_cols"], out["duck_cols"] = sc, dc
        out["status"] = "cols-mismatch"
        return out
    ok = digest(sr) == digest(dr)
    out["status"] = "match" if ok and len(sr) == len(dr) else "value-mismatch"
    if not ok:
        ss, ds = set(sr), set(dr)
        out["only_spark"] = [r for r in sr if r not in ds][:3]
        out["only_duck"] = [r for r in dr if r not in ss][:3]
    return out


def main(argv: list[str]) -> int:
    import importlib.util

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spec = importlib.util.spec_from_file_location("entry", os.path.join(root, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    from ..session import build_session

    spark = build_session()
    qs, oracle = mod.queries(), mod.oracle_sql()
    names = argv or list(qs)
    con = duckdb_conn(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, qs[n], oracle.get(n), sf_dir, con)
        except Exception as e:  # report and go on
            r = {"name": n, "status": "error", "error": repr(e)[:400]}
        if r["status"] not in ("match", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
