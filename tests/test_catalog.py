"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import os

import duckdb
import pytest

from glyphmill.plans import answer_path, catalog  # noqa: F401  (its queries join those of the catalog)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def shape(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    expected = shape(cursor.fetchall(), [d[0] for d in cursor.description])
    assert shape([tuple(r) for r in df.collect()], df.columns) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_linked_components(spark):
    """All orders make links, and all of them count."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in ((r.o_custkey, r.o_orderkey % 500 + 1000000) for r in orders):
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = catalog.QUERIES["linked_components"](spark, SF).collect()
    assert {r.id: r.component for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)
    assert {r.o_custkey for r in orders} <= {r.id for r in got}
