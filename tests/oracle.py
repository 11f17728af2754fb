"""Compare registered queries with their SQL: names, row count, values in any order."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(sf: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, name: str, sf: str, con) -> str | None:
    from zonewatch.catalog import ORACLE, QUERIES
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(v) for v in r) for r in df.select(*cols).collect()]
    if name not in ORACLE:
        return None if got else "no rows"
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    if not got:
        return "no rows at all"
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r) if not any(
        isinstance(x, tuple) for x in r) else (str(r),)
    got, want = sorted(got, key=lambda r: str(r)), sorted(want, key=lambda r: str(r))
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if a != b and not (isinstance(a, float) and isinstance(b, float)
                               and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)):
                return f"{dict(zip(cols, g))} against {dict(zip(cols, w))}"
    return None


if __name__ == "__main__":
    from zonewatch.catalog import ORACLE, QUERIES
    from zonewatch.session import local_session
    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    wanted = sys.argv[1:] or list(QUERIES)
    wanted = [q for q in QUERIES if q in wanted or any(w.endswith("*") and q.startswith(w[:-1]) for w in wanted)]
    conf = {"spark.zonewatch.hotRows": os.environ["HOT"]} if "HOT" in os.environ else {}
    spark, con = local_session(**conf), connect(sf)
    bad = 0
    for n in wanted:
        t = time.time()
        try:
            msg = compare(spark, n, sf, con)
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {time.time() - t:6.1f}s {'' if n in ORACLE else '(rows only) '}{n} {msg or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
