"""Named datasets: each takes a session and a folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from utxolens.operators import (
    accounts,
    change,
    edges,
    entities,
    graph_algorithms,
    graph_queries,
    network_metrics,
    rewards,
    scripts,
    tokens,
    utxo,
)
from utxolens.session import tune
from utxolens.streaming import entity_state, event_windows, feeds, incremental, snapshot_series
from utxolens.sources.derived import Ledger, derived_ledger
from utxolens.sources.sinks import append_batch
from utxolens.sources.storage import WorkTables, is_folder, listing, materialize
from utxolens.sources.streams import file_stream, parsed_messages

Dataset = Callable[[SparkSession, str], DataFrame]
DATASETS: dict[str, Dataset] = {}

# Parameters of the datasets that ask for one object.
STAKE_VIEW = "stake8"
POOL_VIEW = "Supplier#000000005"
EPOCH = 1
TX_HASH = "txda4fb5c6e93e74d3df8527599fa62642"  # of order 120
SLICE = (100, 900)
PAGERANK_ROUNDS = 10
PAGERANK_TOLERANCE = 0.01


# Tables several datasets start from are written once per application and state of a
# folder: the ledger's outputs and spends, as an ingest would, and the entities and their
# graph, since the metrics of a snapshot all read the stored clustering.
_STORED: dict[tuple, tuple[str, StructType]] = {}

# What the ledger is made from: other tables of a folder don't count as its input.
SOURCES = {"customer", "supplier", "part", "orders", "lineitem", "events"}


def _tuned(spark: SparkSession, folder: str) -> tuple:
    """The listing of a folder, after the session was tuned to the size of its tables."""
    found = listing(spark, folder)
    tune(spark, sum(size for name, _, size, _ in found if name.split(".")[0] in SOURCES))
    return found


def stored(name: str, build: Callable[[SparkSession, str], DataFrame]) -> Dataset:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder, _tuned(spark, folder), name)
        if key not in _STORED:
            work = WorkTables(spark, name)
            table = work.write(build(spark, folder), "table")
            _STORED[key] = work.path(table), table.schema
        path, fields = _STORED[key]
        return spark.read.schema(fields).parquet(path)

    return run


# in order of id, neighbours share most of their bytes wherever they are written or moved
stored_outputs = stored(
    "outputs", lambda s, d: derived_ledger(s, d).outputs.sortWithinPartitions("id")
)
stored_spends = stored(
    "tx-in", lambda s, d: derived_ledger(s, d, {"outputs": lambda: stored_outputs(s, d)}).tx_in
)


def ledger_of(spark: SparkSession, folder: str) -> Ledger:
    """The ledger with its two large tables read from where they were written."""
    return derived_ledger(
        spark,
        folder,
        {
            "outputs": lambda: stored_outputs(spark, folder),
            "tx_in": lambda: stored_spends(spark, folder),
        },
    )


def ingest(spark: SparkSession, folder: str) -> None:
    """Write the large ledger tables, if this application has not done so yet."""
    stored_outputs(spark, folder)
    stored_spends(spark, folder)


def dataset(build: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        _tuned(spark, folder)
        return build(ledger_of(spark, folder))

    DATASETS[build.__name__] = run
    return build


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    ledger = ledger_of(spark, folder)
    return entities.entities(ledger.tx_out, ledger.tx_in)


stored_entities = stored("entities", _entities)


def _entity_edges(spark: SparkSession, folder: str) -> DataFrame:
    ledger = ledger_of(spark, folder)
    return entities.entity_edges(stored_entities(spark, folder), ledger.tx_out, ledger.tx_in)


stored_entity_edges = stored("entity-edges", _entity_edges)


def _entity_balances(spark: SparkSession, folder: str) -> DataFrame:
    ledger = ledger_of(spark, folder)
    lifetimes = network_metrics.output_lifetimes(ledger.tx, ledger.tx_in, ledger.tx_out)
    last_block = ledger.tx.agg(F.max("block_id")).scalar()
    return network_metrics.entity_balances(stored_entities(spark, folder), lifetimes, last_block)


stored_entity_balances = stored("entity-balances", _entity_balances)


# Graph algorithms run over address numbers; names come back at the end.
stored_numbers = stored(
    "address-numbers", lambda s, d: entities.address_numbers(ledger_of(s, d).tx_out)
)


def _numbered_pairs(spark: SparkSession, folder: str) -> DataFrame:
    ledger = ledger_of(spark, folder)
    numbered = edges.numbered_outputs(ledger.tx_out, stored_numbers(spark, folder))
    return edges.address_pairs(ledger.tx_in, numbered)


stored_pairs = stored("address-pairs", _numbered_pairs)


def _named(
    df: DataFrame, spark: SparkSession, folder: str, columns: tuple[str, ...] = ("id",)
) -> DataFrame:
    """``df`` with the address numbers in some columns replaced by the addresses."""
    fields = df.columns
    for column in columns:
        names = stored_numbers(spark, folder).select(
            F.col("nr").alias(column), F.col("address").alias(f"_{column}")
        )
        df = df.join(names, column).drop(column).withColumnRenamed(f"_{column}", column)
    return df.select(*fields)


# ------------------------------------------------------------ network


@dataset
def tx_inputs(t):
    return utxo.tx_inputs(t.tx, t.tx_in, t.tx_out)


@dataset
def tx_outputs(t):
    return utxo.tx_outputs(t.tx, t.tx_out)


@dataset
def transaction_network(t):
    return utxo.transaction_network(t.tx, t.tx_in, t.tx_out)


@dataset
def network_in(t):
    return utxo.network_in(t.tx, t.tx_in, t.tx_out)


@dataset
def network_out(t):
    return utxo.network_out(t.tx, t.tx_out)


@dataset
def network_address_outputs(t):
    return utxo.network_address_outputs(t.tx, t.tx_out)


@dataset
def network_pairs(t):
    return utxo.network_pairs(t.tx, t.tx_in, t.tx_out)


@dataset
def network_pairs_all(t):
    return utxo.network_pairs(t.tx, t.tx_in, t.tx_out, different_ends=False)


@dataset
def spent_output_addresses(t):
    return utxo.spent_output_addresses(t.tx, t.tx_in, t.tx_out)


@dataset
def tx_with_output_values(t):
    return utxo.tx_with_output_values(t.tx, t.tx_out)


def _largest_value(t):
    return t.tx_out.agg(F.max("value")).scalar()


@dataset
def outputs_by_value(t):
    return utxo.outputs_by_value(t.tx, t.tx_out, _largest_value(t))


@dataset
def output_input_values(t):
    return utxo.output_input_values(t.tx, t.tx_in, t.tx_out, _largest_value(t))


@dataset
def current_supply(t):
    return utxo.current_supply(t.tx_out, t.tx_in)


@dataset
def addresses(t):
    return utxo.addresses(t.tx_out)


def _early_txs(t):
    """The first half of the transactions."""
    middle = t.tx.agg(F.floor(F.max("id") / 2)).scalar()
    return t.tx.filter(F.col("id") <= middle).select(F.col("id").alias("tx_id"))


def _known_addresses(t):
    """Addresses paid in the first half of the transactions."""
    return utxo.addresses(t.tx_out.join(_early_txs(t), "tx_id", "left_semi"))


@dataset
def new_addresses(t):
    return utxo.new_addresses(t.tx_out, _known_addresses(t))


@dataset
def address_ids(t):
    return utxo.address_ids(t.tx_out)


def _nodes_by_id(t):
    ids = materialize(utxo.address_ids(t.tx_out), "address-ids")
    return materialize(utxo.outputs_by_id(t.tx_out, ids), "nodes")


@dataset
def network_with_ids(t):
    return utxo.network_by_id(t.tx, t.tx_in, _nodes_by_id(t))


@dataset
def network_slice(t):
    return utxo.network_slice(t.tx, t.tx_in, t.tx_out, *SLICE)


@dataset
def co_input_pairs(t):
    return utxo.co_input_pairs(t.tx_out, t.tx_in)


@dataset
def co_input_links(t):
    return utxo.co_input_links(t.tx_out, t.tx_in)


# ------------------------------------------------------------ rewards


def _history(t):
    return rewards.rewards_history(t.reward, t.stake_address, t.pool_hash)


@dataset
def rewards_history(t):
    return rewards.newest_first(_history(t))


@dataset
def reward_history_for_address(t):
    return rewards.reward_history_for_address(_history(t), STAKE_VIEW)


@dataset
def rewards_by_epoch(t):
    return rewards.rewards_by_epoch(_history(t))


@dataset
def rewards_by_pool(t):
    return rewards.rewards_by_pool(_history(t))


@dataset
def distribution_whales(t):
    return rewards.distribution_whales(_history(t))


@dataset
def rewards_by_type(t):
    return rewards.rewards_by_type(t.reward)


@dataset
def ada_rewards_by_type(t):
    return rewards.ada_rewards_by_type(t.reward)


@dataset
def pool_blocks_in_epoch(t):
    return graph_queries.pool_blocks_in_epoch(
        t.block, t.slot_leader, t.pool_hash, EPOCH, POOL_VIEW
    )


@dataset
def pool_rewards_top(t):
    return rewards.pool_rewards_top(t.reward, t.pool_hash)


@dataset
def staking_rewards_top(t):
    return rewards.staking_rewards_top(t.reward, t.stake_address)


@dataset
def total_rewards_per_address(t):
    return rewards.total_rewards_per_address(t.reward, t.treasury, t.stake_address)


# ------------------------------------------------------------ accounts


@dataset
def account_received(t):
    return accounts.account_received(t.tx_out)


@dataset
def account_spent(t):
    return accounts.account_spent(t.tx, t.tx_in, t.tx_out)


@dataset
def account_rewards(t):
    return accounts.account_rewards(t.reward)


@dataset
def account_withdrawals(t):
    return accounts.account_withdrawals(t.withdrawal)


def _account_totals(t, as_coded=False):
    return accounts.account_totals(
        t.tx, t.tx_in, t.tx_out, t.reward, t.withdrawal, t.stake_address, as_coded
    )


@dataset
def account_balance(t):
    return accounts.account_balance(_account_totals(t))


@dataset
def account_balance_as_coded(t):
    return accounts.account_balance(_account_totals(t, as_coded=True))


@dataset
def top_10_balances(t):
    return accounts.top_balances(_account_totals(t))


@dataset
def top_10_sum(t):
    return accounts.top_balances_sum(_account_totals(t))


@dataset
def total_balance(t):
    return accounts.total_balance(_account_totals(t))


def _paid(t):
    return edges.paid_withdrawals(t.withdrawal, t.tx, t.tx_out, t.stake_address)


@dataset
def stake_totals(t):
    return accounts.stake_totals(
        t.stake_address,
        utxo.unspent_outputs(t.tx_out, t.tx_in),
        edges.stake_reward_edges(t.reward, t.stake_address),
        edges.treasury_edges(t.treasury, t.stake_address),
        edges.withdrawal_edges(_paid(t)),
    )


@dataset
def stake_balance_case(t):
    return accounts.stake_balance_case(stake_totals(t))


# ------------------------------------------------------------ scripts


def _script_calls(t, as_coded=False):
    return scripts.script_calls(t.tx, t.redeemer, t.tx_in, t.tx_out, t.block, as_coded)


@dataset
def script_calls(t):
    return _script_calls(t)


@dataset
def script_averages(t):
    return scripts.script_averages(_script_calls(t))


@dataset
def scripts_per_block(t):
    return scripts.scripts_per_block(_script_calls(t))


@dataset
def scripts_by_date(t):
    return scripts.scripts_by_date(_script_calls(t))


# ------------------------------------------------------------ tokens


def _token_types(t):
    return tokens.token_types(
        tokens.token_supply(t.ma_tx_mint), t.multi_asset, t.tx, t.tx_metadata, t.block
    )


@dataset
def token_supply(t):
    return tokens.token_supply(t.ma_tx_mint)


@dataset
def token_types(t):
    return _token_types(t)


@dataset
def tokens_by_day(t):
    return tokens.tokens_by_day(_token_types(t))


@dataset
def distinct_tokens_by_day(t):
    return tokens.tokens_by_day(_token_types(t), distinct_tokens=True)


@dataset
def nfts_by_day(t):
    return tokens.nfts_by_day(_token_types(t))


@dataset
def fts_by_day(t):
    return tokens.fts_by_day(_token_types(t))


@dataset
def tokens_by_supply(t):
    return tokens.tokens_by_supply(_token_types(t))


@dataset
def tokens_unique_supply(t):
    return tokens.tokens_unique_supply(_token_types(t))


# ------------------------------------------------------------ edges


@dataset
def input_edges(t):
    return utxo.input_edges(t.tx_out, t.tx_in)


@dataset
def output_edges(t):
    return utxo.output_edges(t.tx_out, t.tx)


def _token_edges(t):
    return edges.token_edges(t.tx, t.tx_in, t.tx_out, t.ma_tx_out, t.multi_asset)


@dataset
def token_edges(t):
    return _token_edges(t)


@dataset
def minted_in(t):
    return edges.minted_in(t.ma_tx_mint, t.multi_asset, t.tx)


@dataset
def sent_in(t):
    return edges.sent_in(t.ma_tx_out, t.multi_asset, t.tx, t.tx_out)


@dataset
def tx_scripts(t):
    return edges.tx_scripts(t.tx, t.script)


@dataset
def redeemer_scripts(t):
    return edges.redeemer_scripts(t.redeemer, t.script)


@dataset
def redeemer_txs(t):
    return edges.redeemer_txs(t.redeemer, t.tx)


@dataset
def datum_txs(t):
    return edges.datum_txs(t.datum, t.tx)


@dataset
def redeemer_datums(t):
    return edges.redeemer_datums(t.redeemer, t.datum)


@dataset
def stake_reward_edges(t):
    return edges.stake_reward_edges(t.reward, t.stake_address)


@dataset
def pool_reward_edges(t):
    return edges.pool_reward_edges(t.reward, t.pool_hash)


@dataset
def treasury_edges(t):
    return edges.treasury_edges(t.treasury, t.stake_address)


@dataset
def stake_input_edges(t):
    return edges.stake_input_edges(_paid(t))


@dataset
def withdrawal_edges(t):
    return edges.withdrawal_edges(_paid(t))


@dataset
def stake_payment_edges(t):
    return edges.stake_payment_edges(_paid(t), t.tx, t.tx_out)


@dataset
def address_stake_links(t):
    return edges.address_stake_links(t.tx_out, t.stake_address)


@dataset
def co_spent_address_edges(t):
    numbers = materialize(utxo.address_ids(t.tx_out).withColumnRenamed("id", "nr"), "address-ids")
    numbered = edges.numbered_outputs(t.tx_out, numbers)
    return edges.associated_numbers(utxo.co_input_pairs(numbered, t.tx_in, both_orders=False))


@dataset
def transaction_document_sizes(t):
    """Lengths of the nested inputs and outputs of each transaction."""
    size = lambda name: F.sum(F.when(F.col(name).isNull(), 0).otherwise(F.size(name)))
    documents = entities.transaction_documents(t.tx, t.tx_in, t.tx_out)
    return documents.groupBy("id").agg(
        size("inputs").alias("n_inputs"), size("outputs").alias("n_outputs")
    )


@dataset
def nested_transactions(t):
    """The outputs nested in each transaction, one row each."""
    documents = entities.transaction_documents(t.tx, t.tx_in, t.tx_out)
    # both lists at once, so that the documents are made once
    sides = [F.struct(F.lit(name).alias("side"), F.col(name).alias("rows")) for name in ("inputs", "outputs")]
    return (
        documents.select(F.col("id").alias("of_tx"), "hash", "block_id", F.explode(F.array(*sides)).alias("list"))
        .select("of_tx", "hash", "block_id", "list.side", F.explode("list.rows").alias("output"))
        .select("of_tx", "hash", "block_id", "side", "output.*")
    )


@dataset
def neighbour_members(t):
    """The members of each neighbour set: whom an address pays and who pays it."""
    pairs = materialize(edges.address_pairs(t.tx_in, t.tx_out, different_ends=False), "neighbours")

    def members(node: str, neighbour: str, side: str) -> DataFrame:
        sets = edges.neighbour_sets(pairs, node, neighbour)
        return sets.select(
            F.col(node).alias("address"), F.lit(side).alias("side"), F.explode("neighbours").alias("neighbour")
        )

    return members("src", "dst", "outputs").unionByName(members("dst", "src", "inputs"))


@dataset
def adjacency(t):
    """The neighbours of each address in either direction, from lists that are stored in parts."""
    pairs = graph_queries.both_directions(edges.address_pairs(t.tx_in, t.tx_out))
    lists = edges.neighbour_sets(materialize(pairs, "adjacency"), "src", "dst")
    return lists.select(F.col("src").alias("id"), F.explode("neighbours").alias("neighbour"))


@dataset
def network_edge_table(t):
    return graph_queries.network_edge_table(t.tx, t.tx_in, t.tx_out)


@dataset
def weighted_edges(t):
    return graph_queries.weighted_edges(utxo.network_pairs(t.tx, t.tx_in, t.tx_out))


@dataset
def id_edges(t):
    return edges.id_edges(network_with_ids(t))


@dataset
def new_address_ids(t):
    """Ids of the new addresses, following those of the known ones."""
    known = utxo.address_ids(t.tx_out.join(_early_txs(t), "tx_id", "left_semi"))
    return incremental.address_increment({"tx_out": t.tx_out}, known)


@dataset
def network_increment(t):
    """Network rows of the later transactions, as an increment after the earlier."""
    late = lambda df, key: df.join(
        _early_txs(t).withColumnRenamed("tx_id", key), key, "left_anti"
    ).select(*df.columns)
    delta = {"tx": late(t.tx, "id"), "tx_in": late(t.tx_in, "tx_in_id"), "tx_out": late(t.tx_out, "tx_id")}
    return incremental.network_increment(delta, t.tx, t.tx_in, t.tx_out)


@dataset
def entities_incremental(t):
    """Entities of the earlier transactions, carried on through the later ones."""
    early = _early_txs(t)
    state = entity_state.full_state(
        t.tx_out.join(early, "tx_id", "left_semi").select(*t.tx_out.columns),
        t.tx_in.join(early.withColumnRenamed("tx_id", "tx_in_id"), "tx_in_id", "left_semi").select(
            *t.tx_in.columns
        ),
    )
    spends = materialize(change.output_spends(t.tx_out, t.tx_in), "spends")
    late = t.tx.select(F.col("id").alias("tx_id")).join(early, "tx_id", "left_anti")
    return entity_state.update_entities(*state, spends, late)[0]


@dataset
def snapshots(t):
    ends = entity_state.snapshot_cut_offs(t.block)
    return ends.withColumn("snapshot_ts", F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss"))


# ------------------------------------------------------------ graph queries


@dataset
def script_network(t):
    return graph_queries.script_network(t.tx, t.tx_in, t.tx_out, t.script)


@dataset
def plutus_network(t):
    return graph_queries.script_network(t.tx, t.tx_in, t.tx_out, t.script, "plutus")


@dataset
def timelock_network(t):
    return graph_queries.script_network(t.tx, t.tx_in, t.tx_out, t.script, "timelock")


@dataset
def tx_by_hash(t):
    return graph_queries.tx_by_hash(t.tx, t.tx_in, t.tx_out, TX_HASH)


@dataset
def network_table(t):
    payments = edges.stake_payment_edges(_paid(t), t.tx, t.tx_out)
    return graph_queries.network_table(t.tx_in, t.tx_out, t.tx, payments, t.stake_address)


@dataset
def token_transactions(t):
    return graph_queries.token_transactions(_token_edges(t))


@dataset
def token_edge_maps(t):
    """The map of each transfer edge, its entries as sorted text."""
    entries = F.transform(
        F.map_entries("tokens"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    carried = edges.token_edge_maps(_token_edges(t)).filter(F.size("tokens") > 0)
    return carried.withColumn("tokens", F.array_join(F.sort_array(entries), ","))


def _degrees(t):
    return graph_queries.address_degrees(t.tx, t.tx_in, t.tx_out)


@dataset
def top_out_degree(t):
    return graph_queries.top_by_degree(_degrees(t), "out_degree")


@dataset
def top_in_degree(t):
    return graph_queries.top_by_degree(_degrees(t), "in_degree")


@dataset
def top_degree(t):
    return graph_queries.top_by_degree(_degrees(t), "degree")


@dataset
def latest_block(t):
    return graph_queries.latest_block(t.block)


@dataset
def latest_epoch(t):
    return graph_queries.latest_epoch(t.block)


# ------------------------------------------------------------ change and entities


def _spends(t):
    return change.output_spends(t.tx_out, t.tx_in)


@dataset
def change_reuse(t):
    return change.change_reuse(_spends(t))


@dataset
def change_optimal(t):
    spends = _spends(t)
    return change.change_optimal(spends, change.transaction_shapes(spends))


@dataset
def change_optimal_as_coded(t):
    spends = _spends(t)
    return change.change_optimal(spends, change.transaction_shapes(spends), as_coded=True)


@dataset
def change_peeling(t):
    spends = _spends(t)
    return change.change_peeling(spends, change.transaction_shapes(spends))


@dataset
def other_outputs(t):
    spends = _spends(t)
    return entities.other_outputs(spends, change.all_change(spends)).select("id", "tx_id", "address")


@dataset
def change_final(t):
    return change.all_change(_spends(t))


@dataset
def cluster_members(t):
    spends = materialize(_spends(t), "spends")
    return entities.cluster_members(spends, change.all_change(spends))


def _register(name: str, build: Dataset) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        _tuned(spark, folder)
        return build(spark, folder)

    DATASETS[name] = run


_degrees_of_entities = stored(
    "entity-degrees",
    lambda s, d: network_metrics.entity_degrees(stored_entities(s, d), stored_entity_edges(s, d)),
)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("pagerank", F.round("pagerank", 6))


def _first_sources(spark: SparkSession, folder: str, k: int) -> list[int]:
    """The numbers of the k smallest source addresses, as page rank sources."""
    sources = stored_pairs(spark, folder).select(F.col("src").alias("nr")).distinct()
    smallest = sources.join(stored_numbers(spark, folder), "nr").orderBy("address").limit(k)
    return [row.nr for row in smallest.collect()]


_register(
    "in_degrees", lambda s, d: _named(graph_queries.in_degrees(stored_pairs(s, d)), s, d)
)
_register(
    "adjacency_sizes",
    lambda s, d: _named(graph_queries.adjacency_sizes(stored_pairs(s, d)), s, d),
)
_register(
    "triangles", lambda s, d: _named(graph_algorithms.triangle_count(stored_pairs(s, d)), s, d)
)
_register("entities", stored_entities)
_register("entity_edges", stored_entity_edges)
_register("entity_degrees", _degrees_of_entities)
_register(
    "degree_histogram",
    lambda s, d: network_metrics.degree_histogram(_degrees_of_entities(s, d)),
)
_register("entity_balances", stored_entity_balances)
_register(
    "gini",
    lambda s, d: network_metrics.wealth(stored_entity_balances(s, d)).select(
        F.round("gini_index", 9).alias("gini_index"),
        F.round("gini_index_no_zeros", 9).alias("gini_index_no_zeros"),
        "average_wealth",
    ),
)
_register("core_size", lambda s, d: network_metrics.core_size(_degrees_of_entities(s, d)))
_register(
    "core_description", lambda s, d: network_metrics.core_description(_degrees_of_entities(s, d))
)
_register("entity_counts", lambda s, d: network_metrics.entity_counts(stored_entities(s, d)))
_register(
    "addresses_per_entity",
    lambda s, d: network_metrics.addresses_per_entity(stored_entities(s, d)),
)
_register("motif_mutual", lambda s, d: graph_queries.motif_mutual(stored_entity_edges(s, d)))
_register(
    "strong_components",
    lambda s, d: graph_algorithms.strongly_connected_components(stored_entity_edges(s, d)),
)
_register("largest_scc", lambda s, d: graph_algorithms.largest_scc(stored_entity_edges(s, d)))


# What the streams store.
_REWARD_TYPE_TOTALS = "type string, ADA_amount double"
_SUPPLY_PARTS = "ident bigint, quantity bigint, cnt bigint, mtx bigint"
_EVENTS = "event_id bigint, user_id bigint, event_type string"


def _stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables, a file or a folder of files, read as a stream of files."""
    path = f"{folder}/{table}.parquet"
    fields = spark.read.parquet(path).schema
    if is_folder(spark, path):
        return file_stream(spark, path, fields)
    return file_stream(spark, folder, fields, pattern=f"{table}.parquet")


def _stream_rewards_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Totals kept by a streaming aggregate over the events, read back."""
    target = WorkTables(spark, "stream-rewards").folder
    rewards_stream = derived_ledger(
        spark, folder, scan=lambda name: _stream(spark, folder, name)
    ).reward
    feeds.reward_type_feed(rewards_stream, f"{target}/totals", f"{target}/checkpoint")
    return incremental.stored_table(spark, f"{target}/totals", _REWARD_TYPE_TOTALS)


def _stream_token_supply(spark: SparkSession, folder: str) -> DataFrame:
    """Supply added up from the batches of a stream of mints, read back."""
    target = WorkTables(spark, "stream-tokens").folder
    lines = _stream(spark, folder, "lineitem")
    feeds.drain(
        lines,
        lambda batch, batch_id: append_batch(
            tokens.token_supply(
                derived_ledger(spark, folder, scan=lambda name: batch).ma_tx_mint
            ),
            f"{target}/supply",
            batch_id,
        ),
        f"{target}/checkpoint",
    )
    return feeds.read_token_supply(
        incremental.stored_table(spark, f"{target}/supply", _SUPPLY_PARTS)
    )


def _stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON messages in a stream, parsed again and read back."""
    target = WorkTables(spark, "stream-messages").folder
    messages = _stream(spark, folder, "events").select(
        F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value")
    )
    feeds.drain(
        parsed_messages(messages, StructType.fromDDL(_EVENTS)),
        lambda batch, batch_id: append_batch(batch, f"{target}/events", batch_id),
        f"{target}/checkpoint",
    )
    return incremental.stored_table(spark, f"{target}/events", _EVENTS).drop("batch_id")


def _inputs_in_files(spark: SparkSession, ledger: Ledger, target: str) -> DataFrame:
    """The ledger's inputs as a stream of three files, one to a batch."""
    ledger.tx_in.repartitionByRange(3, "id").write.parquet(f"{target}/tx_in")
    return file_stream(spark, f"{target}/tx_in", ledger.tx_in.schema, files_per_batch=1)


def _stream_network(spark: SparkSession, folder: str) -> DataFrame:
    """The network as inputs arrive, in three batches, read back."""
    ledger, target = ledger_of(spark, folder), WorkTables(spark, "stream-network").folder
    inputs = _inputs_in_files(spark, ledger, target)
    feeds.network_feed(inputs, ledger.tx, ledger.tx_out, f"{target}/network", f"{target}/checkpoint")
    return spark.read.parquet(f"{target}/network").drop("batch_id")


def _stream_id_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by address id as inputs arrive, in three batches, read back."""
    ledger, target = ledger_of(spark, folder), WorkTables(spark, "stream-edges").folder
    addresses = materialize(utxo.address_ids(ledger.tx_out), "addresses")
    inputs = _inputs_in_files(spark, ledger, target)
    feeds.edge_feed(inputs, ledger.tx, ledger.tx_out, addresses, target, f"{target}/checkpoint")
    return spark.read.parquet(f"{target}/edges/TRANSACTED_WITH").drop("batch_id")


def _stream_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type, arriving in six batches with some of them late: the counts,
    and per type how many came too late (window_start null)."""
    target = WorkTables(spark, "stream-events").folder
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    # a thirteenth of the events is one batch late, another thirteenth two
    delay = F.when(F.col("event_id") % 13 < 2, F.col("event_id") % 13 + 1).otherwise(0)
    arrival = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 8) + delay
    for batch in range(6):
        events.filter(arrival == batch).write.mode("append").parquet(f"{target}/events")
        arrived = file_stream(spark, f"{target}/events", events.schema)
        event_windows.window_feed(arrived, f"{target}/windows", f"{target}/checkpoint")
    counts = event_windows.read_window_counts(
        incremental.stored_table(spark, f"{target}/windows", event_windows.COUNTS)
    )
    late = event_windows.late_events(events, counts).withColumn("window_start", F.lit(None).cast("timestamp"))
    return counts.unionByName(late).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd")
    )


def _address_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the neighbour sets: who each address pays and who pays it."""
    ledger = ledger_of(spark, folder)
    numbered = edges.numbered_outputs(ledger.tx_out, stored_numbers(spark, folder))
    pairs = materialize(
        edges.address_pairs(ledger.tx_in, numbered, different_ends=False), "neighbours"
    )

    def sizes(node: str, neighbour: str, side: str) -> DataFrame:
        sets = edges.neighbour_sets(pairs, node, neighbour)
        return sets.groupBy(F.col(node).alias("id")).agg(
            F.lit(side).alias("side"), F.sum("size").alias("size")
        )

    both = sizes("src", "dst", "outputs").unionByName(sizes("dst", "src", "inputs"))
    return _named(both, spark, folder)


def _balance_series(spark: SparkSession, folder: str) -> DataFrame:
    """Entity balances at four blocks."""
    ledger = ledger_of(spark, folder)
    last = ledger.tx.agg(F.max("block_id")).first()[0]
    lifetimes = network_metrics.output_lifetimes(ledger.tx, ledger.tx_in, ledger.tx_out)
    cut_offs = [last * quarter // 4 for quarter in (1, 2, 3, 4)]
    return network_metrics.balance_series(lifetimes, stored_entities(spark, folder), cut_offs)


def _snapshot_series(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics at four blocks, carried from each to the next."""
    ledger = ledger_of(spark, folder)
    last = ledger.tx.agg(F.max("block_id")).first()[0]
    found = snapshot_series.snapshot_series(
        ledger.tx, ledger.tx_in, ledger.tx_out, [last * quarter // 4 for quarter in (1, 2, 3, 4)]
    )
    return found.withColumns(
        {name: F.round(name, 9) for name in ("gini_index", "gini_index_no_zeros")}
    )


def _series_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios of the snapshot at the last block."""
    last = ledger_of(spark, folder).tx.agg(F.max("block_id")).scalar()
    stamped = [
        df.withColumn("snapshot_ts", last)
        for df in (
            network_metrics.entity_counts(stored_entities(spark, folder)),
            network_metrics.core_size(_degrees_of_entities(spark, folder)),
            graph_algorithms.largest_scc(stored_entity_edges(spark, folder)),
        )
    ]
    return network_metrics.series_ratios(*stamped)


_register("stream_messages", _stream_messages)
_register("stream_network", _stream_network)
_register("stream_id_edges", _stream_id_edges)
_register("stream_event_windows", _stream_event_windows)
_register("address_neighbours", _address_neighbours)
_register("balance_series", _balance_series)
_register("series_ratios", _series_ratios)
_register("snapshot_series", _snapshot_series)
_register("stream_ada_rewards_by_type", _stream_rewards_by_type)
_register("stream_token_supply", _stream_token_supply)
_register(
    "pagerank",
    lambda s, d: _named(
        _rounded(graph_algorithms.pagerank(stored_pairs(s, d), tol=PAGERANK_TOLERANCE)), s, d
    ),
)
_register(
    "pagerank_fixed",
    lambda s, d: _named(
        _rounded(graph_algorithms.pagerank(stored_pairs(s, d), max_iter=PAGERANK_ROUNDS)), s, d
    ),
)
_register(
    "pagerank_personal",
    lambda s, d: _named(
        _rounded(
            graph_algorithms.pagerank(
                stored_pairs(s, d),
                max_iter=PAGERANK_ROUNDS,
                source=_first_sources(s, d, 1)[0],
            )
        ),
        s,
        d,
    ),
)
_register(
    "pagerank_parallel",
    lambda s, d: _named(
        _rounded(
            graph_algorithms.parallel_personalized_pagerank(
                stored_pairs(s, d), _first_sources(s, d, 4), PAGERANK_ROUNDS
            )
        ),
        s,
        d,
        ("id", "source_id"),
    ),
)
