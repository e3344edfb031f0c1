"""Compare a query with its SQL: columns by name, rows as a multiset, doubles to ten digits."""

import decimal
import glob
import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "tzinfo") and getattr(x, "tzinfo", None):
        return x.replace(tzinfo=None)
    return x


def counted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, query, sql, data=DATA):
    found = query(spark, data)
    with duckdb.connect() as db:
        for p in glob.glob(f"{data}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        cursor = db.execute(sql)
        names, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(found.columns) == sorted(names)
    got = counted(found.columns, [tuple(r) for r in found.collect()])
    want = counted(names, want)
    assert not got - want and not want - got, (list((got - want).items())[:3], list((want - got).items())[:3])
