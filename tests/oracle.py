"""Compare registered queries with their checking SQL.

``python tests/oracle.py [folder] [name prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tablegauge.plans.inputs import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value + 0.0))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value).hex()
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, query, sql):
    """(equal, message, rows)"""
    df = query(spark, folder)
    names, rows = table_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, "no checking SQL", len(rows)
    cur = con.execute(sql)
    want_names, want = table_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return False, f"columns {names} != {want_names}", len(rows)
    if rows == want:
        return True, "equal", len(rows)
    left = [r for r in rows if r not in set(want)][:3]
    right = [r for r in want if r not in set(rows)][:3]
    return False, f"{len(rows)} rows against {len(want)}\n   {names}\n   ours {left}\n   want {right}", len(rows)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tablegauge.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(folder)
    checks, bad = oracle_sql(), []
    for name, query in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            ok, message, n = compare(spark, con, folder, query, checks.get(name))
        except Exception as error:  # noqa: BLE001
            ok, message, n = False, f"{type(error).__name__}: {str(error)[:1500]}", 0
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - start:.1f}s rows={n} {message}", flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
