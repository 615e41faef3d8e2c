"""Compare a query with its SQL on the same tables."""

import math
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(root):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{root}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(con, df, sql):
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(x) for x in row)) for row in df.select(*columns).collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(plain(row[i]) for i in order)) for row in found.fetchall())
    assert ours == theirs
