"""Named datasets against their SQL texts; ``compare.py`` runs all of them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from utxolens.plans import catalog, oracle

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "transaction_network",
    "account_balance",
    "script_calls",
    "token_types",
    "token_edge_maps",
    "account_balance_as_coded",
    "tx_by_hash",
    "stake_balance_case",
    "network_with_ids",
    "entity_degrees",
    "snapshots",
    "stream_token_supply",
]


def test_every_dataset_has_a_sql_text():
    assert set(catalog.DATASETS) == set(oracle.oracle_sql())
    assert set(catalog.DATASETS) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "tx_hash"


@pytest.mark.parametrize("name", SAMPLE)
def test_dataset_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for file in glob.glob(f"{SMALL}/*.parquet"):
        table = os.path.basename(file)[: -len(".parquet")]
        duck.execute(f"create view {table} as select * from '{file}'")
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    got = entry.queries()[name](spark, SMALL).select(*columns)
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    assert sorted(map(key, got.collect())) == sorted(map(key, result.fetchall()))
