"""Run registered queries beside their oracle SQL and compare as sorted value tuples."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


TIMES: list[float] = []


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(v):
    return type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(df, con, sql: str) -> str:
    """Empty text if equal, else what differs."""
    t0 = time.time()
    collected = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    fetched = cur.fetchall()
    TIMES[:] = [t1 - t0, time.time() - t1]
    left_names, left = rows_of(df.columns, collected)
    right_names, right = rows_of([d[0] for d in cur.description], fetched)
    if left_names != right_names:
        return f"columns {left_names} vs {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(left_names, a, b) if x != y]
            return f"first difference {bad[:4]}"
        kinds = [(n, kind(x), kind(y)) for n, x, y in zip(left_names, a, b) if kind(x) != kind(y)]
        if kinds:
            return f"types {kinds[:4]}"
    return ""


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from stayline.session import local_session

    sf = "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                diff = compare(df, con, oracles[name])
                n = df.count() if diff else "-"
            else:
                n, diff = len(df.collect()), ""
                diff = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", "-"
        mark = "ok " if not diff else "BAD"
        bad += bool(diff)
        print(f"\n{mark} {name} {'sql' if name in oracles else 'rows'} {n} {time.time() - start:.2f}s (run, oracle: {[round(t, 2) for t in TIMES]}) {diff}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")


if __name__ == "__main__":
    main(sys.argv[1:])
