"""Run registered queries against their SQL twins in an in-process DuckDB and compare values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DUCK_OF = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    desc = con.execute(f"DESCRIBE {sql}").fetchall()
    d_types = {r[0]: r[1] for r in desc}
    want = con.execute(sql).fetchall()
    if sorted(types) != sorted(d_types):
        return f"columns {sorted(types)} vs {sorted(d_types)}"
    bad = {c: (t, d_types[c]) for c, t in types.items() if DUCK_OF.get(t, t) != d_types[c]}
    if bad:
        return f"types {bad}"
    a, b = canonical(rows, list(types)), canonical(want, [r[0] for r in desc])
    if a != b:
        sa, sb = set(a), set(b)
        return f"rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]} (columns {sorted(types)})"
    return None if rows else "empty result"


def main(argv):
    import traceback

    from posegrid.catalog import load
    from posegrid.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    queries, oracles = load()
    spark = local_session()
    con = connect(sf)
    pick = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    for n in pick:
        t = time.time()
        try:
            if n in oracles:
                t_duck = time.time()
                diff = compare(spark, con, n, queries[n], oracles[n], sf)
            else:
                c = queries[n](spark, sf).count()
                diff = None if c else "no rows"
                diff = diff and diff
        except Exception as e:  # report and go on
            msg = str(e).split("JVM stacktrace")[0]
            diff = f"ERROR {type(e).__name__}: {msg[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok  ' if diff is None else 'FAIL'} {n} {time.time() - t:.1f}s {'' if n in oracles else '(rows only)'} {diff or ''}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
