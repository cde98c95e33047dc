"""Every registered query against its SQL on the smallest data folder."""

import pytest

import __spark_entry__ as driver
from shelfledger.registry import QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    rows, problems = compare(spark, FOLDER, QUERIES[name], connection)
    assert not problems, "\n".join(problems)
    assert rows > 0


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns == [
        "product_id",
        "product_name",
        "category",
        "quantity_sold",
        "total_unit_price",
    ]
