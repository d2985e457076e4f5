"""Compares registered queries with their check SQL. Usage: python tests/check.py [prefix ...]"""

from __future__ import annotations

import logging
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}; extra {[r for r in got if r not in set(want)][:2]} missing {[r for r in want if r not in set(got)][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return len(got), f"{len(bad)} rows differ, e.g. {str(bad[0][0])[:1500]}\n   want {str(bad[0][1])[:1500]}" if bad else None


def main():
    from hiremill.plans import catalog
    from hiremill.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    logging.disable(logging.CRITICAL)
    con = connect(sf)
    failed = []
    for name, fn in catalog.QUERIES.items():
        if len(sys.argv) > 1 and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        t = time.time()
        try:
            if name in catalog.ORACLES:
                n, err = compare(spark, con, sf, fn, catalog.ORACLES[name])
            else:
                n, err = fn(spark, sf).count(), None
        except Exception as e:  # noqa: BLE001
            n, err = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        note = "" if name in catalog.ORACLES else " (no sql)"
        print(f"{'FAIL' if err else 'ok  '} {name}{note} rows={n} {time.time() - t:.1f}s {err or ''}", flush=True)
        if err:
            failed.append(name)
    print("failed:", failed)
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
