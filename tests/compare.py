"""Holds queries against their DuckDB equivalents: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def cell(x):
    import datetime
    import decimal

    if x is None:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in rows], key=repr)


def connection(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def compare(spark, sf_dir, name, function, sql, c):
    began = time.time()
    df = function(spark, sf_dir)
    got = df.collect()
    took = time.time() - began
    if sql is None:
        return len(got), None, None, took
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    a, b = rows_of(df.columns, got), rows_of(names, want)
    same = sorted(df.columns) == sorted(names) and a == b
    return len(got), len(want), None if same else [x for x in a if x not in set(b)][:3] + ["<>"] + [x for x in b if x not in set(a)][:3] + [sorted(df.columns), sorted(names)], took


if __name__ == "__main__":
    import __spark_entry__ as entry
    from plantweave.session import session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, c = session(8), connection(sf_dir)
    for name, function in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            n, m, wrong, took = compare(spark, sf_dir, name, function, entry.oracle_sql().get(name), c)
            print(f"{'OK  ' if wrong is None and m is not None else 'ROWS' if m is None else 'DIFF'} {name} {n} {m} {took:.1f}s", *([str(wrong)[:900]] if wrong else []), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name} {type(e).__name__} {str(e)[:700]}", flush=True)
