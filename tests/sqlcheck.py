"""The comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        v = v.replace(tzinfo=None)
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, query, sql: str, sf_dir: str = SMALL) -> None:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got, expected = rows_of(df.columns, df.collect()), rows_of(names, want.fetchall())
    assert len(got) == len(expected), (len(got), len(expected))
    bad = [(g, e) for g, e in zip(got, expected, strict=True) if g != e]
    assert not bad, f"{len(bad)} rows differ: {bad[:3]}"
