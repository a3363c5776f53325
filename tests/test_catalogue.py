"""Every registered query of the core runs, and equals its SQL where it has one."""

import datetime
import decimal

import duckdb
import pytest

from veilspan.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert rows
        return
    rel = db.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    assert rows == sorted(([plain(dict(zip(rel.columns, r))[c]) for c in columns] for r in rel.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
