"""Plans: what reaches the scan, what is split, what is shared."""

import pytest
from pyspark.sql import functions as F

from utxolens.functions.hot_keys import join_back
from utxolens.operators import change, edges, entities, graph_algorithms, graph_queries, utxo
from utxolens.plans import catalog
from utxolens.sources import storage
from utxolens.sources.derived import derived_ledger
from utxolens.streaming import entity_state

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_partitions(spark):
    """Thresholds of skew handling scaled down to the test data."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_a_hot_transaction_is_split(spark, small_partitions):
    """Transaction 0 spends a third of all outputs; its part of the join is split."""
    n = 6000
    made = spark.range(n).selectExpr(
        "id", "id % 2000 as tx_id", "cast(id / 2000 as int) as idx", "concat('a', id) as address",
        "concat('r', id) as address_raw", "id as stake_address_id", "id as value",
    )
    spends = made.selectExpr(
        "id", "if(id % 3 = 0, 0L, id % 2000) as tx_in_id", "tx_id as tx_out_id",
        "idx as tx_out_index", "cast(null as bigint) as redeemer_id",
    )
    tx = spark.range(2000).selectExpr("id", "concat('h', id) as hash", "id as block_id")
    network = utxo.transaction_network(tx, spends.repartition(8), made.repartition(8))
    got = network.collect()
    assert "skew=true" in plan(network)
    hot = [r for r in got if r.tx_hash == "h0"]
    assert len(hot) >= n // 3 * 3 - 10 and len(got) == len(set(got))
    degrees = graph_queries.address_degrees(tx, spends, made)
    assert degrees.agg(F.sum("out_degree")).first()[0] == len(got)


def test_chosen_transactions_cut_both_sides_first(spark):
    ledger = derived_ledger(spark, SMALL)
    tx, tx_in, tx_out = (
        storage.materialize(df, name)
        for df, name in ((ledger.tx, "tx"), (ledger.tx_in, "tx-in"), (ledger.tx_out, "tx-out"))
    )
    hashed = tx.filter(F.col("id") == 120).first().hash
    found = graph_queries.tx_by_hash(tx, tx_in, tx_out, hashed)
    text = plan(found)
    assert text.count("LeftSemi") == 2
    every = utxo.network_edges(tx, tx_in, tx_out).filter(F.col("tx_hash") == hashed)
    assert found.count() == every.count() > 0


def test_only_needed_columns_are_read(spark):
    text = plan(derived_ledger(spark, SMALL).block.agg(F.max("block_no")))
    assert "ReadSchema: struct<o_orderkey:bigint>" in text
    text = plan(derived_ledger(spark, SMALL).treasury)
    assert "EqualTo(event_type,signup)" in text and "props" not in text


def test_the_network_needs_no_shuffle_of_its_rows(spark):
    ledger = derived_ledger(spark, SMALL)
    network = utxo.transaction_network(ledger.tx, ledger.tx_in, ledger.tx_out)
    top = plan(network).split("Exchange")[0]
    assert "Aggregate" not in top.split("Join")[0]


def test_totals_are_limited_before_they_are_sorted(spark):
    ledger = derived_ledger(spark, SMALL)
    degrees = graph_queries.address_degrees(ledger.tx, ledger.tx_in, ledger.tx_out)
    assert "TakeOrderedAndProject" in plan(graph_queries.top_by_degree(degrees, "degree"))


def test_work_tables_never_share_a_path(spark):
    work = storage.WorkTables(spark, "test")
    for i in range(4):
        # the table before is no longer referred to
        table = work.write(spark.range(i), "rows")
    assert work.path(table).endswith("00003-rows") and table.count() == 3


def test_work_tables_use_the_shared_folder(spark, tmp_path):
    assert storage.shared_folder(spark) == storage.shared_folder(spark)
    work = storage.WorkTables(spark, "test")
    table = work.write(spark.range(3), "rows")
    assert table.inputFiles()[0].startswith("file:") and table.count() == 3
    work.drop(table)
    with pytest.raises(Exception):
        spark.read.parquet(work.folder + "/00000-rows")


def hot_spends(spark, folder):
    """Spends and members with a third of the rows on transaction 0, as written tables."""
    n = 9000
    tx_id = F.expr("if(id % 3 = 0, 0L, id % 3000 + 1)")
    spends = spark.range(n).select(
        "id",
        tx_id.alias("tx_id"),
        (F.col("id") % 7).alias("value"),
        F.expr("concat('address of some length ', id)").alias("address"),
        F.expr("if(id % 3 = 1, 0L, id % 3000 + 5)").alias("spent_in"),
        F.expr("cast(id as int)").alias("idx"),
    )
    spends.repartition(8).write.parquet(f"{folder}/spends")
    return spark.read.parquet(f"{folder}/spends")


def _components(spends):
    links = spends.select(F.col("id").alias("high"), F.expr("if(id % 3 = 0, -1L, -id % 2999)").alias("low"))
    return graph_algorithms._large_star(links)


def _small_components(spends):
    links = spends.select(F.expr("if(id % 3 = 0, 10000L, id % 2999 + 10001)").alias("high"), F.col("id").alias("low"))
    return graph_algorithms._small_star(links)


def _shapes(spends):
    return spends.groupBy("tx_id").agg(
        F.lit(2).alias("n_inputs"), F.lit(2).alias("n_outputs"), (F.min("value") + 3).alias("least_input")
    )


HOT = {
    "large star": _components,
    "small star": _small_components,
    "member links": lambda s: entities.member_links(
        s.select("tx_id", "address"), s.select("address", F.col("id").alias("nr"))
    ),
    "cluster members": lambda s: entities.cluster_members(s, s.select("tx_id", F.col("id").alias("out_id")).limit(0)),
    "optimal change": lambda s: change.change_optimal(s, _shapes(s)),
    "optimal change as coded": lambda s: change.change_optimal(s, _shapes(s), True),
    "peeling change": lambda s: change.change_peeling(s, _shapes(s).withColumn("n_inputs", F.lit(1))),
    "neighbour sets": lambda s: edges.neighbour_sets(s.select("tx_id", "address"), "tx_id", "address").withColumn(
        "neighbours", F.sort_array("neighbours")
    ),
    "edge weights": lambda s: graph_algorithms.edge_weights(s.select(F.col("tx_id").alias("src"), F.col("id").alias("dst"))),
    "degrees": lambda s: join_back(s.select("tx_id", "id"), s.groupBy("tx_id").count(), "tx_id"),
}


@pytest.mark.parametrize("name", HOT)
def test_a_hot_key_meets_its_aggregate_in_several_tasks(spark, small_partitions, tmp_path, name):
    spends = hot_spends(spark, str(tmp_path))
    found = HOT[name](spends)
    got = sorted(map(str, found.collect()))
    assert "skew=true" in plan(found)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got == sorted(map(str, HOT[name](spends).collect())) and got
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def test_join_back_keeps_types_of_join_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    totals = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, join_back(rows, totals, "k").collect())) == [(1, "a", 2), (1, "b", 2), (2, "c", 1)]
    left = join_back(rows, totals.filter("k = 1"), "k", how="left")
    assert sorted((r.v, r.n) for r in left.collect() if r.n) == [("a", 2), ("b", 2)] and left.count() == 4
    semi = join_back(rows, totals.filter("n > 1"), "k", how="left_semi")
    assert semi.columns == ["k", "v"] and semi.count() == 2


GROUPED = ["neighbour sets", "cluster members", "optimal change"]


@pytest.mark.parametrize("name", GROUPED)
def test_rows_that_met_their_totals_are_grouped_where_they_lie(spark, small_partitions, tmp_path, name):
    found = HOT[name](hot_spends(spark, str(tmp_path)))
    above = plan(found).split("SortMergeJoin")[0]
    assert "Aggregate" in above and "Exchange" not in above


def test_links_are_made_distinct_before_they_are_turned(spark):
    pairs = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("d", None), (None, "d"), (None, None), ("b", "d")]
    found = graph_queries.both_directions(spark.createDataFrame(pairs, "src string, dst string"))
    want = {*pairs, *[(dst, src) for src, dst in pairs]}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Exchange" not in plan(found).split("Generate")[0] and plan(found).count("Union") == 0


def test_entity_edges_need_no_address_after_the_entities_are_known(spark):
    ledger = derived_ledger(spark, SMALL)
    entity = ledger.tx_out.groupBy("address").agg(F.min("id").alias("entity_id"))
    text = plan(entities.entity_edges(entity, ledger.tx_out, ledger.tx_in))
    assert "address#" not in text and "entity_id#" in text


def test_components_are_named_by_one_join(spark):
    links = spark.createDataFrame([(5, 3), (3, 9), (8, 7), (9, 1), (7, 7)], "src long, dst long")
    found = graph_algorithms.connected_components(links)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (3, 1), (5, 1), (7, 7), (8, 7), (9, 1)]
    assert plan(found).split("== Initial Plan")[0].count("Join") == 1 and "Union" not in plan(found)


def test_the_rules_of_an_increment_read_rows_worked_out_once(spark):
    ledger = derived_ledger(spark, SMALL)
    spends = storage.materialize(change.output_spends(ledger.tx_out, ledger.tx_in), "spends")
    touched = ledger.tx.filter("id % 3 = 0").select(F.col("id").alias("tx_id"))
    found = entity_state.members_of(spends, touched)
    want = entities.cluster_members(spends, change.all_change(spends)).join(touched, "tx_id", "left_semi")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "-rows" in plan(found) and "spends" not in plan(found)


def test_a_table_on_both_sides_of_a_join_is_shuffled_once(spark, small_partitions):
    links = storage.materialize(spark.range(500).selectExpr("id as src", "id * 7 % 90 as dst"), "links")
    present = links.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    members = storage.materialize(spark.range(500).selectExpr("id % 90 as tx_id", "concat('a', id) as address"), "members")
    numbers = storage.materialize(members.selectExpr("address", "cast(substring(address, 2) as long) as nr"), "numbers")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "ReusedExchange" in plan(graph_algorithms._hooked(present, 5))
        linked = plan(entities.member_links(members, numbers))
        assert linked.count("Scan parquet") - linked.count("ReusedExchange") <= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_shapes_are_worked_out_once_for_all_rules(spark):
    ledger = derived_ledger(spark, SMALL)
    spends = storage.materialize(change.output_spends(ledger.tx_out, ledger.tx_in), "spends")
    text = plan(change.all_change(spends))
    assert "shapes-" in text and "sum(output" not in text


def test_members_need_no_count_by_address(spark):
    ledger = derived_ledger(spark, SMALL)
    spends = storage.materialize(change.output_spends(ledger.tx_out, ledger.tx_in), "spends")
    found = entities.cluster_members(spends, change.all_change(spends))
    assert "all_uses" in plan(found) and "sum(uses" not in plan(found)


def test_stored_outputs_lie_in_order(spark):
    found = catalog.stored_outputs(spark, SMALL).select("id", F.spark_partition_id().alias("part")).collect()
    for part in {r.part for r in found}:
        ids = [r.id for r in found if r.part == part]
        # a task may read several files one after the other
        assert sum(b < a for a, b in zip(ids, ids[1:])) < 8


def test_ids_are_known_before_inputs_meet_outputs(spark):
    ledger = derived_ledger(spark, SMALL)
    ids = utxo.address_ids(ledger.tx_out).filter("id % 5 > 0")
    network = utxo.transaction_network(ledger.tx, ledger.tx_in, ledger.tx_out)
    want = utxo.network_with_ids(network, ledger.tx, ids)
    found = utxo.network_by_id(ledger.tx, ledger.tx_in, utxo.outputs_by_id(ledger.tx_out, ids))
    assert found.columns == want.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    edge_table = catalog.DATASETS["id_edges"](spark, SMALL)
    assert "Aggregate" not in plan(edge_table).split("Exchange")[0].split("Join")[0]
    # no join above the pairs looks an address up
    assert "address#" not in plan(edge_table)


def test_co_spent_pairs_move_as_numbers(spark):
    ledger = derived_ledger(spark, SMALL)
    pairs = utxo.co_input_pairs(ledger.tx_out, ledger.tx_in)
    want = edges.associated_edges(pairs, utxo.address_ids(ledger.tx_out))
    found = catalog.DATASETS["co_spent_address_edges"](spark, SMALL)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert plan(found).split("Aggregate")[0].count("Join") == 0


def test_digests_are_not_shuffled(spark):
    found = utxo.address_ids(spark.range(50).select(F.concat(F.lit("a"), "id").alias("address")))
    assert [r.id for r in found.orderBy("id").collect()] == list(range(1, 51))
    by_digest = found.withColumn("digest", F.md5("address")).orderBy("digest").collect()
    assert [r.id for r in by_digest] == list(range(1, 51))
    moved = [line for line in plan(found).splitlines() if "Exchange" in line]
    assert moved and "_md5" not in plan(found).split("Exchange hashpartitioning(_bucket")[1]
