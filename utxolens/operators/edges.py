"""Property-graph vertices and edges as tables.

An edge exists once per distinct pair of ends and properties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.functions.amounts import ada, long_sum, token_text
from utxolens.functions.hot_keys import DEAL, join_back
from utxolens.operators.utxo import input_edges, output_edges, spent_outputs


def _ids(df: DataFrame, name: str, key: str = "id") -> DataFrame:
    return df.select(F.col(key).alias(name))


def minted_in(ma_tx_mint: DataFrame, multi_asset: DataFrame, tx: DataFrame) -> DataFrame:
    """Asset to the transaction that mints it."""
    return (
        ma_tx_mint.select(F.col("ident").alias("asset_id"), "tx_id", "quantity")
        .distinct()
        .join(_ids(multi_asset, "asset_id"), "asset_id", "left_semi")
        .join(_ids(tx, "tx_id"), "tx_id", "left_semi")
        .select("asset_id", "tx_id", "quantity")
    )


def sent_in(
    ma_tx_out: DataFrame, multi_asset: DataFrame, tx: DataFrame, tx_out: DataFrame
) -> DataFrame:
    """Asset to the transaction whose output carries it."""
    outputs = tx_out.select(F.col("id").alias("tx_out_id"), "tx_id")
    return (
        ma_tx_out.join(outputs, "tx_out_id")
        .select(F.col("ident").alias("asset_id"), "tx_id", "quantity")
        .distinct()
        .join(_ids(multi_asset, "asset_id"), "asset_id", "left_semi")
        .join(_ids(tx, "tx_id"), "tx_id", "left_semi")
        .select("asset_id", "tx_id", "quantity")
    )


def tx_scripts(tx: DataFrame, script: DataFrame) -> DataFrame:
    """Transaction to the scripts it includes."""
    return (
        script.select("tx_id", F.col("hash").alias("script_hash"))
        .distinct()
        .join(_ids(tx, "tx_id"), "tx_id", "left_semi")
    )


def redeemer_scripts(redeemer: DataFrame, script: DataFrame) -> DataFrame:
    return (
        redeemer.select(F.col("id").alias("redeemer_id"), "script_hash")
        .distinct()
        .join(_ids(script, "script_hash", "hash"), "script_hash", "left_semi")
        .select("redeemer_id", "script_hash")
    )


def redeemer_txs(redeemer: DataFrame, tx: DataFrame) -> DataFrame:
    return (
        redeemer.select(F.col("id").alias("redeemer_id"), "tx_id")
        .distinct()
        .join(_ids(tx, "tx_id"), "tx_id", "left_semi")
        .select("redeemer_id", "tx_id")
    )


def datum_txs(datum: DataFrame, tx: DataFrame) -> DataFrame:
    return (
        datum.select(F.col("id").alias("datum_id"), "tx_id")
        .distinct()
        .join(_ids(tx, "tx_id"), "tx_id", "left_semi")
        .select("datum_id", "tx_id")
    )


def redeemer_datums(redeemer: DataFrame, datum: DataFrame) -> DataFrame:
    return (
        redeemer.select(F.col("id").alias("redeemer_id"), "datum_id")
        .distinct()
        .join(_ids(datum, "datum_id"), "datum_id", "left_semi")
        .select("redeemer_id", "datum_id")
    )


def stake_reward_edges(reward: DataFrame, stake_address: DataFrame) -> DataFrame:
    """Reward to the stake address that receives it."""
    return (
        reward.select(
            F.col("id").alias("reward_id"), F.col("addr_id").alias("stake_address_id"), "amount"
        )
        .distinct()
        .join(_ids(stake_address, "stake_address_id"), "stake_address_id", "left_semi")
        .select("reward_id", "stake_address_id", "amount")
    )


def pool_reward_edges(reward: DataFrame, pool_hash: DataFrame) -> DataFrame:
    """Reward to the pool it comes from."""
    return (
        reward.select(F.col("id").alias("reward_id"), "pool_id", "amount")
        .distinct()
        .join(_ids(pool_hash, "pool_id"), "pool_id", "left_semi")
        .select("reward_id", "pool_id", "amount")
    )


def treasury_edges(treasury: DataFrame, stake_address: DataFrame) -> DataFrame:
    """Treasury payment to the stake address that receives it."""
    return (
        treasury.select(
            F.col("id").alias("treasury_id"), F.col("addr_id").alias("stake_address_id"), "amount"
        )
        .distinct()
        .join(_ids(stake_address, "stake_address_id"), "stake_address_id", "left_semi")
        .select("treasury_id", "stake_address_id", "amount")
    )


def matched_addresses(tx_out: DataFrame, stake_address: DataFrame) -> DataFrame:
    """Distinct (stake_address_id, address) seen together on an output."""
    return (
        tx_out.select("stake_address_id", "address")
        .distinct()
        .join(_ids(stake_address, "stake_address_id"), "stake_address_id", "left_semi")
    )


def address_stake_links(tx_out: DataFrame, stake_address: DataFrame) -> DataFrame:
    """Addresses with the name of their stake address."""
    names = stake_address.select(F.col("id").alias("stake_address_id"), "view")
    pairs = tx_out.select("stake_address_id", "address").distinct()
    return pairs.join(names, "stake_address_id").select("address", "view").distinct()


def paid_withdrawals(
    withdrawal: DataFrame, tx: DataFrame, tx_out: DataFrame, stake_address: DataFrame
) -> DataFrame:
    """Withdrawals whose transaction pays an address of the withdrawing account.

    Only outputs of transactions with a withdrawal meet the matched addresses.
    """
    accounts_paid = (
        tx_out.select("tx_id", "address")
        .join(withdrawal.select("tx_id"), "tx_id", "left_semi")
        .distinct()
        .join(matched_addresses(tx_out, stake_address), "address")
        .select("tx_id", "stake_address_id")
        .distinct()
    )
    return (
        withdrawal.select(
            F.col("id").alias("withdrawal_id"),
            F.col("addr_id").alias("stake_address_id"),
            "tx_id",
            F.col("amount").alias("value"),
        )
        .join(accounts_paid, ["tx_id", "stake_address_id"], "left_semi")
        .join(_ids(tx, "tx_id"), "tx_id", "left_semi")
    )


def stake_input_edges(paid: DataFrame) -> DataFrame:
    """Stake address to the transaction it feeds, from :func:`paid_withdrawals`."""
    return paid.select("stake_address_id", "tx_id", "value").distinct()


def withdrawal_edges(paid: DataFrame) -> DataFrame:
    """Stake address to the withdrawals it made, from :func:`paid_withdrawals`."""
    return paid.select("stake_address_id", "withdrawal_id", "value").distinct()


def stake_payment_edges(
    paid: DataFrame, tx: DataFrame, tx_out: DataFrame, in_ada: bool = True
) -> DataFrame:
    """Stake address to the addresses its transactions pay.

    Both sides are distinct before they meet, so the edges are too.
    """
    hashes = tx.select(F.col("id").alias("tx_id"), F.col("hash").alias("tx_hash"))
    outputs = tx_out.select("tx_id", "address", F.col("value").alias("amount")).distinct()
    scale = ada if in_ada else F.col
    return (
        stake_input_edges(paid)
        .join(hashes, "tx_id")
        .join(outputs, "tx_id")
        .select(
            "stake_address_id",
            "address",
            "tx_hash",
            scale("value").alias("ADA_Input"),
            scale("amount").alias("ADA_Output"),
        )
    )


def token_edges(
    tx: DataFrame,
    tx_in: DataFrame,
    tx_out: DataFrame,
    ma_tx_out: DataFrame,
    multi_asset: DataFrame,
) -> DataFrame:
    """Token transfers between different addresses: one row per transfer edge and
    token, with the quantity its spent outputs carried.

    Each side is summed up per transaction, address, amount and token name before
    the two sides are joined on transaction and token.
    """
    names = multi_asset.select(F.col("id").alias("ident"), token_text("name").alias("token"))
    carried = (
        ma_tx_out.select(F.col("tx_out_id").alias("id"), "ident", "quantity")
        .join(names, "ident")
        .drop("ident")
    )
    # outputs with tokens, before either side is looked up
    holding = tx_out.select("id", "tx_id", "idx", "address", "value").join(carried, "id")
    spent = (
        spent_outputs(holding, tx_in)
        .groupBy(
            F.col("spent_in").alias("tx_id"),
            "token",
            F.col("address").alias("src"),
            F.col("value").alias("input_value"),
        )
        .agg(long_sum("quantity").alias("quantity"))
    )
    made = holding.select(
        "tx_id", "token", F.col("address").alias("dst"), F.col("value").alias("output_value")
    ).distinct()
    hashes = tx.select(F.col("id").alias("tx_id"), F.col("hash").alias("tx_hash"))
    return (
        spent.join(made, ["tx_id", "token"])
        .filter(F.col("src") != F.col("dst"))
        .join(hashes, "tx_id")
        .select(
            "src",
            "dst",
            "tx_hash",
            ada("input_value").alias("ADA_Input"),
            ada("output_value").alias("ADA_Output"),
            "token",
            "quantity",
        )
    )


def token_edge_maps(token_rows: DataFrame) -> DataFrame:
    """Transfer edges with a ``tokens`` map from token to quantity."""
    return token_rows.groupBy("src", "dst", "tx_hash", "ADA_Input", "ADA_Output").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "quantity"))).alias("tokens")
    )


def id_edges(network: DataFrame) -> DataFrame:
    """Address-to-address edges by integer id, from the network with ids."""
    return network.select(
        F.col("input_addr_id").alias("src"),
        F.col("output_addr_id").alias("dst"),
        "tx_hash",
        "tx_id",
        F.col("input_ADA_value").alias("input"),
        F.col("output_ADA_value").alias("output"),
    )


def associated_edges(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Co-spent address pairs by integer id, once per pair of addresses."""
    left = ids.select(F.col("address").alias("input1"), F.col("id").alias("src"))
    right = ids.select(F.col("address").alias("input2"), F.col("id").alias("dst"))
    return (
        pairs.select("input1", "input2")
        .distinct()
        .join(left, "input1")
        .join(right, "input2")
        .select("src", "dst")
    )


def associated_numbers(pairs: DataFrame) -> DataFrame:
    """:func:`associated_edges` where the pairs, each in one order, are of address ids already:
    (src, dst) in both orders, once each. Only half of the edges move."""
    once = pairs.select("input1", "input2").distinct()
    ends = F.explode(
        F.array(
            F.struct(F.col("input1").alias("src"), F.col("input2").alias("dst")),
            F.struct(F.col("input2").alias("src"), F.col("input1").alias("dst")),
        )
    )
    return once.select(ends.alias("edge")).select("edge.*")


def numbered_outputs(tx_out: DataFrame, numbers: DataFrame) -> DataFrame:
    """Outputs with the number of their address as ``address``.

    Graphs over numbers shuffle eight bytes per end instead of a whole address.
    """
    return (
        tx_out.select("id", "tx_id", "idx", "address")
        .join(numbers, "address")
        .select("id", "tx_id", "idx", F.col("nr").alias("address"))
    )


def address_pairs(tx_in: DataFrame, tx_out: DataFrame, different_ends: bool = True) -> DataFrame:
    """Distinct (src, dst) of addresses with a transaction between them.

    ``different_ends=False`` keeps an address that pays itself.
    """
    inputs = (
        spent_outputs(tx_out, tx_in)
        .select(F.col("spent_in").alias("tx_id"), F.col("address").alias("src"))
        .distinct()
    )
    outputs = tx_out.select("tx_id", F.col("address").alias("dst")).distinct()
    pairs = inputs.join(outputs, "tx_id").select("src", "dst")
    if different_ends:
        pairs = pairs.filter(F.col("src") != F.col("dst"))
    return pairs.distinct()


def neighbour_sets(pairs: DataFrame, node: str, neighbour: str, max_size: int = 120_000) -> DataFrame:
    """Neighbours of each node as arrays of at most about ``max_size`` members.

    A node with more neighbours has several parts, so that no single row or task
    holds all the neighbours of a very busy address. ``size`` is that of the part.
    """
    sizes = pairs.groupBy(node).agg(F.count("*").alias("_degree"))
    # twice as many parts as the mean asks for, since members are spread by hash
    parts = F.when(F.col("_degree") <= max_size, 1).otherwise(
        F.ceil(F.col("_degree") * 2 / max_size)
    )
    return (
        join_back(pairs, sizes, node, keep=True)
        .withColumn("part", F.pmod(F.xxhash64(neighbour), parts))
        # a node's rows lie together already, unless it is a hot one that was split
        .groupBy(node, DEAL, "part")
        .agg(F.collect_list(neighbour).alias("neighbours"))
        .drop(DEAL)
        .withColumn("size", F.size("neighbours"))
    )


def input_output_edges(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Both directions of address-to-transaction edges in one table."""
    into = input_edges(tx_out, tx_in).join(_ids(tx, "tx_id"), "tx_id", "left_semi")
    return (
        into.withColumn("type", F.lit("INPUT_TO"))
        .unionByName(output_edges(tx_out, tx).withColumn("type", F.lit("OUTPUT_TO")))
        .select("address", "tx_id", "amount", "type")
    )
