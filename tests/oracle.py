"""Runs registered queries on Spark and their SQL on DuckDB and compares the results.

Usage: python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
         "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(df, con, sql: str) -> tuple[bool, str]:
    rel = con.sql(sql)
    got_cols, want_cols = sorted(df.columns), sorted(rel.columns)
    if got_cols != want_cols:
        return False, f"columns differ: {set(got_cols) ^ set(want_cols)}"
    want_types = {c: TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    types = [(c, t, want_types[c]) for c, t in df.dtypes if t != want_types[c]]
    rows = [tuple(norm(r[c]) for c in got_cols) for r in df.collect()]
    at = [rel.columns.index(c) for c in want_cols]
    want = [tuple(norm(r[i]) for i in at) for r in rel.fetchall()]
    if len(rows) != len(want):
        return False, f"rows {len(rows)} vs {len(want)}"
    a, b = Counter(rows), Counter(want)
    if a != b:
        left, right = list((a - b).items())[:2], list((b - a).items())[:2]
        return False, f"{sum((a - b).values())} rows differ {got_cols}\n   spark {left}\n   sql   {right}"
    note = f"{len(rows)} rows" + (f" TYPES {types}" if types else "")
    return not types and len(rows) > 0, note


def main() -> None:
    from cohortspark import get_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:]
    queries, oracle = entry.queries(), entry.oracle_sql()
    spark, con = get_session("oracle", "8"), duck(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                ok, note = compare(df, con, oracle[name])
            else:
                n = len(df.collect())
                ok, note = n > 0, f"{n} rows (no SQL)"
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.1f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
