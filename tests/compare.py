"""Compare a query's rows with its SQL, columns by name, order aside."""

import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def connect(folder):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def same(spark, con, folder, run, sql):
    df = run(spark, folder)
    cols = sorted(df.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    r = con.sql(sql)
    names = r.columns
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=key)
    assert got == want
