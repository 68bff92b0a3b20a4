"""Compare registered queries with their SQL on an independent engine.

Usage: python tests/compare.py [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    )


def compare(spark, con, folder, name, fn, sql):
    t = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    if sql is None:
        return f"rows={len(got)} (no sql) {spent:.1f}s", True
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", False
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; spark only {only[0]}; sql only {only[1]}", False
    types = {c[0]: str(c[1]) for c in cur.description}
    loose = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int"}
    off = [(n, t, dict(df.dtypes)[n]) for n, t in types.items() if loose.get(t, dict(df.dtypes)[n]) != dict(df.dtypes)[n]]
    note = f" TYPES {off}" if off else ""
    return f"ok rows={len(a)} {spent:.1f}s{note}", not off


def main(prefixes):
    import __spark_entry__ as entry

    from docledger.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            text, ok = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001
            text, ok = f"ERROR {str(exc)[:600]}", False
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name}: {text}", flush=True)
    print(f"{bad} not matching")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
