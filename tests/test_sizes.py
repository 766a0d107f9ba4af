"""What moves, and over how many partitions, as the input grows."""

import time

import pytest
from pyspark.sql import functions as F

from tests.test_plans import plan
from utxolens.operators import change, entities, network_metrics
from utxolens.plans import catalog
from utxolens.session import ADVISORY_SIZE, INITIAL_PARTITIONS, INPUT_PER_PARTITION, tune
from utxolens.sources import storage
from utxolens.sources.derived import derived_ledger
from utxolens.sources.storage import materialize

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def settings(spark):
    names = [INITIAL_PARTITIONS, ADVISORY_SIZE, "spark.sql.shuffle.partitions"]
    before = {name: spark.conf.get(name, None) for name in names}
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffled_in(spark):
    found = plan(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    return int(found.split("Exchange hashpartitioning(")[1].split("), ENSURE")[0].split(", ")[-1])


def test_partitions_of_a_shuffle_grow_with_the_input(spark, settings):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    for parts, size in ((5, 0), (5, INPUT_PER_PARTITION), (70, 70 * INPUT_PER_PARTITION), (5, 1)):
        tune(spark, size)
        assert shuffled_in(spark) == parts


def test_small_partitions_are_not_joined_beyond_what_a_session_allows(spark, settings):
    spark.conf.set(ADVISORY_SIZE, "64MB")
    tune(spark)
    assert int(spark.conf.get(ADVISORY_SIZE).rstrip("b")) == 16 << 20
    spark.conf.set(ADVISORY_SIZE, "10k")
    tune(spark)
    assert int(spark.conf.get(ADVISORY_SIZE).rstrip("b")) == 10 << 10


def test_only_tables_of_the_ledger_count_as_its_input(spark, settings, tmp_path, monkeypatch):
    monkeypatch.setattr("utxolens.session.INPUT_PER_PARTITION", 1000)
    (tmp_path / "documents.parquet").write_bytes(bytes(90_000))
    (tmp_path / "lineitem.parquet").write_bytes(bytes(30_000))
    catalog._tuned(spark, str(tmp_path))
    assert shuffled_in(spark) == 30


def lifetimes_of(spark):
    ledger = derived_ledger(spark, SMALL)
    return network_metrics.output_lifetimes(ledger.tx, ledger.tx_in, ledger.tx_out)


def entity_of(spark):
    return spark.createDataFrame([("addr1", 1)], "address string, entity_id bigint")


def test_outputs_that_do_not_count_are_dropped_before_blocks_are_looked_up(spark):
    found = network_metrics.entity_balances(entity_of(spark), lifetimes_of(spark), 30)
    text = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda *parts: next(i for i, line in enumerate(text) if all(p in line for p in parts))
    assert at("Join Inner, (tx_id") < at("Filter", "spent_block") < at("Join LeftOuter, ((tx_id")


def test_a_series_of_balances_moves_an_address_once(spark):
    found = network_metrics.balance_series(lifetimes_of(spark), entity_of(spark), [3, 9, 30])
    assert "Window" not in plan(found) and "Union" not in plan(found)


def test_inputs_are_made_distinct_once(spark):
    ledger = derived_ledger(spark, SMALL)
    spends = materialize(change.output_spends(ledger.tx_out, ledger.tx_in), "spends")
    found = entities.cluster_members(spends, spends.select("tx_id", F.col("id").alias("out_id")).limit(0))
    text = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Aggregate [" in line and "address#" in line for line in text) == 1
    repeated = spends.unionByName(spends)
    again = entities.cluster_members(repeated, spends.select("tx_id", F.col("id").alias("out_id")).limit(0))
    assert again.count() == again.distinct().count()


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_of_a_work_table_go_with_its_write(spark):
    rows = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffle_files(spark)
    table = materialize(rows, "counted")
    ends = time.time() + 20
    while shuffle_files(spark) - before and time.time() < ends:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(storage.CLEANUP, None) is None
    # the same rows can be asked for again
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, table.collect()))
    assert materialize(rows, "again").count() == 7


def test_nested_outputs_are_dealt_once(spark, settings):
    """Outputs move to their spenders and to their transaction, and no further."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalog.DATASETS["nested_transactions"](spark, SMALL)
        count = found.count()
        found.collect()
        text = plan(found).split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in text.splitlines() if " Exchange hashpartitioning(" in line]
    # outputs and spends by (tx_id, idx), counts, dealt counts, dealt rows, dealt transactions
    assert len(moved) <= 7, text
    assert found.distinct().count() == count > 0


def test_repeated_rows_are_nested_once(spark):
    ledger = derived_ledger(spark, SMALL)
    tx, tx_in, tx_out = ledger.tx, ledger.tx_in, ledger.tx_out
    sizes = lambda df: sorted(
        (r.id, len(r.inputs or []), len(r.outputs or [])) for r in df.collect()
    )
    once = sizes(entities.transaction_documents(tx, tx_in, tx_out))
    assert sizes(entities.transaction_documents(tx, tx_in.unionByName(tx_in), tx_out.unionByName(tx_out))) == once
