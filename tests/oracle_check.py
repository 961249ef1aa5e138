"""Run registered queries in Spark and their oracle SQL in DuckDB and compare
(row count, column names, order-insensitive values with doubles rounded).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, q, sf_dir):
    t0 = time.time()
    sdf = q.fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    ts = time.time() - t0
    if q.oracle is None:
        return {"name": name, "status": "rows-only", "rows": len(srows), "sec": round(ts, 2)}
    t1 = time.time()
    res = con.execute(q.oracle)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    td = time.time() - t1
    info = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "sec": round(ts, 2), "duck_sec": round(td, 2)}
    if sorted(scols) != sorted(dcols):
        info.update(status="COLUMNS", spark=sorted(scols), oracle=sorted(dcols))
        return info
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a == b:
        info["status"] = "ok"
    else:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        info.update(status="VALUES", sample=diff, cols=sorted(scols))
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from flowguard.session import build_session
    from flowguard.plans import catalog

    spark = build_session()
    con = duck(sf_dir)
    qs = catalog.all_queries()
    bad = 0
    for name, q in qs.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            info = compare(spark, con, name, q, sf_dir)
        except Exception as exc:  # report and go on
            info = {"name": name, "status": "ERROR", "error": f"{type(exc).__name__}: {str(exc)[:400]}"}
        if info["status"] not in ("ok", "rows-only"):
            bad += 1
        print(info, flush=True)
    print(f"bad={bad} of {len(qs)}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
