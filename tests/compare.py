"""Runs registered queries next to their DuckDB oracle: ``python -m tests.compare [sf] [prefix ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (v + 0.0 if v else 0.0)
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time() else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return [names[i] for i in order], body


def compare(spark, con, query, sql, sf_dir):
    start = time.time()
    df = query(spark, sf_dir)
    built = time.time() - start
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES[:] = [built, time.time() - start]
    if sql is None:
        return f"rows={len(got[1])}" if got[1] else "EMPTY", dict(df.dtypes), {}
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", dict(df.dtypes), types
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} != {len(want[1])}", dict(df.dtypes), types
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"VALUES {len(bad)}/{len(want[1])} {got[0]} spark={bad[0][0]} duck={bad[0][1]}", dict(df.dtypes), types
    return f"ok {len(got[1])}" if got[1] else "EMPTY", dict(df.dtypes), types


TIMES = [0.0, 0.0]
SAME = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in sorted(queries.items()):
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            status, mine, theirs = compare(spark, con, query, oracle.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            status, mine, theirs = f"ERROR {type(e).__name__} {str(e)[:900]}", {}, {}
        failed += not (status.startswith("ok") or status.startswith("rows="))
        odd = {c: (mine[c], theirs[c]) for c in theirs if c in mine and SAME.get(mine[c], mine[c]) != theirs[c]}
        print(f"{name:38s} build {TIMES[0]:5.1f} spark {TIMES[1]:6.2f} all {time.time() - start:6.2f}s {status}" + (f"  TYPES {odd}" if odd else ""), flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
