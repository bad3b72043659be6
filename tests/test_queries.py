"""Every query of the catchment operators against its SQL in another engine."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from reachwell.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    ours = sorted(([plain(row[c]) for c in columns] for row in df.collect()), key=repr)
    found = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(([plain(row[names.index(c)]) for c in columns] for row in found.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == sorted(df.columns, key=df.columns.index) and df.count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
