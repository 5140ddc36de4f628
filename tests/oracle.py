"""Compare registered queries with their SQL twins."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


_TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_cell(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    spark_types = dict(df.dtypes)
    odd = {c: (spark_types[c], types[c]) for c in cols if _TYPES.get(types[c], types[c]) != spark_types[c]}
    if odd:
        return f"types {odd}"
    idx = [names.index(c) for c in cols]
    want = [tuple(_cell(r[i]) for i in idx) for r in rows]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        if a != b:
            return f"values {str(a)[:600]} vs {str(b)[:600]}"
    return None if got else "EMPTY"


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from webcorpus.plans import catalog
    from webcorpus.session import build_session

    sf = sys.argv[1]
    prefixes = tuple(sys.argv[2].split(",")) if len(sys.argv) > 2 else ("",)
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    Q, O = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name, fn in Q.items():
        if not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            res = compare(spark, con, fn, O[name], sf) if name in O else f"rows-only {len(fn(spark, sf).collect())}"
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:900]}"
        ok = res is None or res.startswith("rows-only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t0:.1f}s {res or ''}", flush=True)
    print("bad:", bad)
