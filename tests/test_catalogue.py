"""Every query against its SQL, and an import without the optional subpackage's modules."""

import duckdb
import pytest

from sparkrecon.plans import catalogue, flows, readings  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


def rounded(row):
    return tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((rounded(r[c] for c in columns) for r in df.collect()), key=repr)
    if name in catalogue.ORACLE:
        other = duck.sql(catalogue.ORACLE[name])
        places = [other.columns.index(c) for c in columns]
        assert sorted(other.columns) == columns
        assert sorted((rounded(r[i] for i in places) for r in other.fetchall()), key=repr) == rows
