"""Every registered sports query against its SQL in DuckDB."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

from fieldhouse.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    got = multiset(df.columns, df.collect())
    rel = connect(sf).sql(SQL[name])
    want = multiset(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1], f"only here {list((got[1] - want[1]).items())[:3]}, only there {list((want[1] - got[1]).items())[:3]}"
    assert sum(got[1].values()) > 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
