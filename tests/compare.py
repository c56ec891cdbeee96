"""Run registered queries against DuckDB on the same files and compare every value."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, fn, oracle: str | None):
    """(message or None, row count); a message means a difference."""
    df = fn(spark, sf)
    cols = df.columns
    mine = _rows(cols, [tuple(r) for r in df.collect()])
    if oracle is None:
        return None, len(mine)
    cur = con.execute(oracle)
    theirs_cols = [d[0] for d in cur.description]
    theirs = _rows(theirs_cols, cur.fetchall())
    if sorted(cols) != sorted(theirs_cols):
        return f"columns {sorted(cols)} != {sorted(theirs_cols)}", len(mine)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}", len(mine)
    # repr also tells an int from a double and 1.0 from 1.00
    bad = [(a, b) for a, b in zip(mine, theirs) if repr(a) != repr(b)]
    if bad:
        return f"{len(bad)} rows differ, first:\n  spark {str(bad[0][0])[:600]}\n  duck  {str(bad[0][1])[:600]}", len(mine)
    return None, len(mine)


def main(argv):
    from tidemark.session import build_session
    from tidemark import plans
    sf = f"/root/testdata/{argv[0]}"
    want = argv[1:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = 0
    oracles = plans.all_oracles()
    for name, fn in plans.all_queries().items():
        if want and not any(name == w or name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            problem, n = compare(spark, con, sf, fn, oracles.get(name))
        except Exception as ex:  # report and go on
            problem, n = f"{type(ex).__name__}: {str(ex)[:1500]}", 0
        mark = "ok  " if problem is None else "FAIL"
        failed += problem is not None
        note = "" if name in oracles else " (rows only)"
        if n == 0 and problem is None:
            note += " EMPTY"
        print(f"{mark} {name} {n} rows {time.time() - t:.1f}s{note}", *([problem] if problem else []), flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
