"""Every registered query against its reference SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, connect
from tapeloom import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.merged("QUERIES"), registry.merged("ORACLE")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, *_ = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert verdict == "ok", verdict


def test_entry(spark):
    df = contract.entry(spark)
    assert {"trade_date", "symbol", "score", "rank", "weight"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES) and set(contract.oracle_sql()) <= set(contract.queries())
