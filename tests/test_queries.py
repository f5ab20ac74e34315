"""Every query with SQL against DuckDB on the small tables, and that the others run."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    frame = catalog.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(shown, r)) for r in frame.select(*columns).collect())
    found = duck.execute(catalog.oracle_sql()[name])
    at = [x[0] for x in found.description]
    assert sorted(at) == columns
    assert got == sorted(tuple(shown(r[at.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert {r.origin for r in entry.entry(spark).collect()} == {"project", "engine"}
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
