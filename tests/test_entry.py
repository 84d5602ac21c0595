"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from dialoglake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_and_twin_agree_on_names_and_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(catalog.ORACLES[name])
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    twin = [c[0] for c in cur.description]
    assert names == sorted(twin)
    at = [twin.index(n) for n in names]
    ours, theirs = [tuple(plain(r[n]) for n in names) for r in df.collect()], [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
