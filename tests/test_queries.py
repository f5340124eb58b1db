"""Every query with a SQL equivalent gives the same rows in Spark and in DuckDB; the others run and keep their schema."""

import math

import duckdb
import pytest

from lexloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)) or hasattr(x, "as_tuple"):
        return "nan" if math.isnan(float(x)) else f"{float(x):.6f}"
    return str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in found)


def compare(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    found = rows(got.columns, got.collect())
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        wanted = rows(want.columns, want.fetchall())
        assert found[0] == wanted[0]
        assert len(found[1]) == len(wanted[1]), (len(found[1]), len(wanted[1]), found[1][:2], wanted[1][:2])
        wrong = [(a, b) for a, b in zip(*[found[1], wanted[1]]) if a != b]
        assert not wrong, (len(wrong), wrong[:3])
    assert found[1]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    compare(spark, duck, sf, name)
