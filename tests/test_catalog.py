import duckdb
import pytest

import __spark_entry__ as contract
from check import compare
from tidalframe.plans import catalog
from tidalframe.plans.standins import TABLES

FOLDER = "/root/testdata/sf0.001"

# Every operator of the inventory, by its ID.
INVENTORY = (
    [f"s{i}" for i in range(1, 12)] + [f"p{i}" for i in range(1, 11)] + [f"j{i}" for i in range(1, 8)]
    + [f"a{i}" for i in range(1, 24)] + [f"w{i}" for i in range(1, 8)] + [f"o{i}" for i in range(1, 7)] + ["u1", "u2"]
    + [f"c{i}" for i in range(1, 19)] + [f"m{i}" for i in range(1, 22)] + [f"r{i}" for i in range(1, 5)]
    + [f"i{i}" for i in range(1, 7)] + ["t1"]
)
catalog.load_all()
QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


def test_every_operator_has_a_query():
    registered = {name.split("_")[0] for name in QUERIES}
    assert registered == set(INVENTORY)
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith(("s10", "a15"))))
def test_query_equals_its_sql(spark, db, name):
    ok, note, _ = compare(spark, db, name, FOLDER)
    assert ok, note


def test_entry(spark):
    assert contract.entry(spark).count() == 5
