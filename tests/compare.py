"""A query against its SQL in DuckDB, as bags of rows."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def same(df, sql: str, sf: str = SF) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    expected = Counter(tuple(_plain(r[i]) for i in at) for r in want.fetchall())
    got = Counter(tuple(_plain(v) for v in r) for r in df.select(*columns).collect())
    assert got == expected, f"extra {list((got - expected).items())[:3]}, missing {list((expected - got).items())[:3]}"
