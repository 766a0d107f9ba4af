"""Spent and unspent outputs, and the address-to-address transaction network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.functions.amounts import ada, ada_sum
from utxolens.functions.hot_keys import join_back
from utxolens.functions.ranking import dense_ids


def spent_outputs(tx_out: DataFrame, tx_in: DataFrame) -> DataFrame:
    """Outputs with the transaction that spends them (``spent_in``)."""
    spends = tx_in.select(
        F.col("tx_out_id").alias("tx_id"),
        F.col("tx_out_index").alias("idx"),
        F.col("tx_in_id").alias("spent_in"),
        "redeemer_id",
    )
    return tx_out.join(spends, ["tx_id", "idx"])


def unspent_outputs(tx_out: DataFrame, tx_in: DataFrame) -> DataFrame:
    spends = tx_in.select(
        F.col("tx_out_id").alias("tx_id"), F.col("tx_out_index").alias("idx")
    )
    return tx_out.join(spends, ["tx_id", "idx"], "left_anti")


def input_edges(tx_out: DataFrame, tx_in: DataFrame) -> DataFrame:
    """Distinct (address, spending transaction, amount)."""
    return (
        spent_outputs(tx_out, tx_in)
        .select("address", F.col("spent_in").alias("tx_id"), F.col("value").alias("amount"))
        .distinct()
    )


def output_edges(tx_out: DataFrame, tx: DataFrame) -> DataFrame:
    """Distinct (transaction, address, amount) for outputs of known transactions."""
    known = tx.select(F.col("id").alias("tx_id"))
    return (
        tx_out.select("tx_id", "address", F.col("value").alias("amount"))
        .distinct()
        .join(known, "tx_id", "left_semi")
    )


def tx_inputs(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Distinct spent inputs of each transaction.

    Two equal-valued outputs that one transaction paid to one address are one
    row here, because the output index is not among the columns.
    """
    hashes = tx.select(F.col("id").alias("spent_in"), F.col("hash").alias("tx_hash"))
    return (
        spent_outputs(tx_out, tx_in)
        .select("spent_in", "address", "tx_id", F.col("value").alias("input_value"))
        .distinct()
        .join(hashes, "spent_in")
        .select("tx_hash", "address", "tx_id", "input_value")
    )


def tx_outputs(tx: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Distinct outputs of each transaction."""
    hashes = tx.select(F.col("id").alias("tx_id"), "hash")
    return (
        tx_out.select(
            "tx_id",
            "address_raw",
            F.col("address").alias("address_output"),
            "idx",
            F.col("value").alias("output_value"),
        )
        .distinct()
        .join(hashes, "tx_id")
        .select("hash", "tx_id", "address_raw", "address_output", "idx", "output_value")
    )


def network_edges(
    tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, chosen: bool = False
) -> DataFrame:
    """(tx_id, tx_hash, input_addr, output_addr, input_value, output_value).

    Both sides lose their repeats before they meet, so the joined rows are
    distinct without a shuffle of the much larger result. With ``chosen``, ``tx`` is a
    small part of the ledger: inputs and outputs are cut to it before anything else.
    """
    made = tx_out
    if chosen:
        tx_in = tx_in.join(tx.select(F.col("id").alias("tx_in_id")), "tx_in_id", "left_semi")
        made = tx_out.join(tx.select(F.col("id").alias("tx_id")), "tx_id", "left_semi")
    inputs = input_edges(tx_out, tx_in).select(
        "tx_id", F.col("address").alias("input_addr"), F.col("amount").alias("input_value")
    )
    outputs = (
        made.select(
            "tx_id", F.col("address").alias("output_addr"), F.col("value").alias("output_value")
        ).distinct()
    )
    hashes = tx.select(F.col("id").alias("tx_id"), F.col("hash").alias("tx_hash"))
    return (
        inputs.join(hashes, "tx_id")
        .join(outputs, "tx_id")
        .filter(F.col("input_addr") != F.col("output_addr"))
    )


def transaction_network(
    tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, chosen: bool = False
) -> DataFrame:
    """Input address to output address of each transaction, amounts in ADA."""
    return network_edges(tx, tx_in, tx_out, chosen).select(
        "tx_hash",
        "input_addr",
        "output_addr",
        ada("input_value").alias("input_ADA_value"),
        ada("output_value").alias("output_ADA_value"),
    )


def network_in(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Every spent output with the hash of the transaction that spends it."""
    hashes = tx.select(F.col("id").alias("spent_in"), F.col("hash").alias("tx_hash"))
    return spent_outputs(tx_out, tx_in).join(hashes, "spent_in").select(*tx_out.columns, "tx_hash")


def network_out(tx: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Every output of a known transaction, all its columns."""
    return tx_out.join(tx.select(F.col("id").alias("tx_id")), "tx_id").select(*tx_out.columns)


def network_address_outputs(tx: DataFrame, tx_out: DataFrame) -> DataFrame:
    hashes = tx.select(F.col("id").alias("tx_id"), "hash")
    return tx_out.join(hashes, "tx_id").select(
        "id", F.col("address").alias("address_output"), "hash"
    )


def network_pairs(
    tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, different_ends: bool = True
) -> DataFrame:
    """Each spent output beside each output of the spending transaction.

    Repeats are kept. With ``different_ends=False`` equal addresses stay too, and
    inputs of a transaction without outputs get a null output.
    """
    inputs = network_in(tx, tx_in, tx_out).select(
        F.col("address").alias("input"), "tx_hash", "value"
    )
    outputs = network_address_outputs(tx, tx_out).select(
        F.col("hash").alias("tx_hash"), F.col("address_output").alias("output")
    )
    if different_ends:
        pairs = inputs.join(outputs, "tx_hash").filter(F.col("input") != F.col("output"))
    else:
        pairs = inputs.join(outputs, "tx_hash", "left")
    return pairs.select("input", "output", "tx_hash", ada("value").alias("ADA_value"))


def spent_output_addresses(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Outputs matched with their own later spend, by output id."""
    made = network_address_outputs(tx, tx_out).select("id", "address_output")
    used = network_in(tx, tx_in, tx_out).select("id", "address")
    return made.join(used, "id").select("address_output", "address")


def tx_with_output_values(tx: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Every transaction with the value of each output; null without outputs."""
    values = tx_out.select(F.col("tx_id").alias("id"), "value")
    return tx.join(values, "id", "left").select(*tx.columns, "value")


def outputs_by_value(tx: DataFrame, tx_out: DataFrame, value: Column | int) -> DataFrame:
    value = value if isinstance(value, Column) else F.lit(value)
    return network_out(tx, tx_out.filter(F.col("value") == value))


def output_input_values(
    tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, value: Column | int
) -> DataFrame:
    """Outputs of one value beside the spent outputs made by the same transaction."""
    outputs = outputs_by_value(tx, tx_out, value).select(
        "tx_id", F.col("address").alias("output_address"), F.col("value").alias("output_value")
    )
    spent = network_in(tx, tx_in, tx_out).select(
        "tx_id", F.col("address").alias("input_address"), F.col("value").alias("input_value")
    )
    return outputs.join(spent, "tx_id").select(
        "output_address", "input_address", "output_value", "input_value"
    )


def current_supply(tx_out: DataFrame, tx_in: DataFrame) -> DataFrame:
    return unspent_outputs(tx_out, tx_in).agg(ada_sum("value").alias("current_supply"))


def addresses(tx_out: DataFrame) -> DataFrame:
    return tx_out.select("address").distinct()


def new_addresses(tx_out: DataFrame, known: DataFrame) -> DataFrame:
    """Addresses of ``tx_out`` that ``known`` does not hold."""
    return addresses(tx_out).join(known.select("address"), "address", "left_anti")


def address_ids(tx_out: DataFrame, last_id: int = 0) -> DataFrame:
    """Consecutive integer ids for the distinct addresses."""
    return dense_ids(addresses(tx_out), "address", last_id=last_id).select("id", "address")


def network_with_ids(network: DataFrame, tx: DataFrame, ids: DataFrame) -> DataFrame:
    """The network with the transaction id and both address ids, null if unknown."""
    tx_ids = tx.select(F.col("hash").alias("tx_hash"), F.col("id").alias("tx_id"))
    sources = ids.select(F.col("address").alias("input_addr"), F.col("id").alias("input_addr_id"))
    targets = ids.select(F.col("address").alias("output_addr"), F.col("id").alias("output_addr_id"))
    return (
        network.join(tx_ids, "tx_hash", "left")
        .join(sources, "input_addr", "left")
        .join(targets, "output_addr", "left")
        .select(
            "tx_id",
            "tx_hash",
            "input_addr_id",
            "output_addr_id",
            "input_ADA_value",
            "output_ADA_value",
        )
    )


def outputs_by_id(tx_out: DataFrame, ids: DataFrame) -> DataFrame:
    """(tx_id, idx, value, address_id, unknown): every output with an address; ``unknown`` is
    the address itself where ``ids`` has none for it."""
    known = ids.select("address", F.col("id").alias("address_id"))
    return (
        tx_out.select("tx_id", "idx", "address", "value")
        .filter(F.col("address").isNotNull())
        .join(known, "address", "left")
        .select("tx_id", "idx", "value", "address_id", F.when(F.col("address_id").isNull(), F.col("address")).alias("unknown"))
    )


def network_by_id(
    tx: DataFrame, tx_in: DataFrame, nodes: DataFrame, chosen: bool = False
) -> DataFrame:
    """:func:`network_with_ids` of the whole network, from :func:`outputs_by_id`.

    Ids take the place of addresses before inputs meet outputs, so the pairs, by far the
    largest table, are never shuffled to be looked up. With ``chosen``, ``tx_in`` holds a
    part of the inputs: the outputs are cut to their transactions first.
    """
    spends = tx_in.select(
        F.col("tx_out_id").alias("tx_id"), F.col("tx_out_index").alias("idx"), F.col("tx_in_id").alias("spent_in")
    )
    inputs = (
        nodes.join(spends, ["tx_id", "idx"])
        .select(
            F.col("spent_in").alias("tx_id"),
            F.col("address_id").alias("input_addr_id"),
            F.col("unknown").alias("unknown_input"),
            F.col("value").alias("input_value"),
        )
        .distinct()
    )
    made = nodes
    if chosen:
        touched = tx_in.select(F.col("tx_in_id").alias("tx_id")).distinct()
        tx = tx.join(touched.withColumnRenamed("tx_id", "id"), "id", "left_semi")
        made = nodes.join(touched, "tx_id", "left_semi")
    outputs = made.select(
        "tx_id",
        F.col("address_id").alias("output_addr_id"),
        F.col("unknown").alias("unknown_output"),
        F.col("value").alias("output_value"),
    ).distinct()
    hashes = tx.select(F.col("id").alias("tx_id"), F.col("hash").alias("tx_hash"))
    same = F.col("input_addr_id").eqNullSafe(F.col("output_addr_id")) & F.col("unknown_input").eqNullSafe(
        F.col("unknown_output")
    )
    return (
        inputs.join(hashes, "tx_id")
        .join(outputs, "tx_id")
        .filter(~same)
        .select(
            "tx_id",
            "tx_hash",
            "input_addr_id",
            "output_addr_id",
            ada("input_value").alias("input_ADA_value"),
            ada("output_value").alias("output_ADA_value"),
        )
    )


def id_range(df: DataFrame, column: str, low: int | Column, high: int | Column) -> DataFrame:
    """Rows with ``low <= column <= high``."""
    return df.filter(F.col(column).between(low, high))


def network_slice(
    tx: DataFrame,
    tx_in: DataFrame,
    tx_out: DataFrame,
    low: int | Column,
    high: int | Column,
) -> DataFrame:
    """The network of transactions ``low <= id <= high``, cut before the joins."""
    return network_edges(id_range(tx, "id", low, high), tx_in, tx_out).select(
        "tx_id",
        "input_addr",
        "output_addr",
        ada("input_value").alias("input_ADA_value"),
        ada("output_value").alias("output_ADA_value"),
    )


def tx_input_addresses(tx_out: DataFrame, tx_in: DataFrame) -> DataFrame:
    """Distinct (tx_id, address) of the inputs of each transaction."""
    return (
        spent_outputs(tx_out, tx_in)
        .select(F.col("spent_in").alias("tx_id"), "address")
        .distinct()
    )


def co_input_links(tx_out: DataFrame, tx_in: DataFrame) -> DataFrame:
    """Co-spent addresses as one link per address to the first address of its
    transaction: the same groups as :func:`co_input_pairs` in linear size."""
    inputs = tx_input_addresses(tx_out, tx_in)
    first = inputs.groupBy("tx_id").agg(F.min("address").alias("input1"))
    return (
        join_back(inputs, first, "tx_id")
        .filter(F.col("address") != F.col("input1"))
        .select("tx_id", "input1", F.col("address").alias("input2"))
    )


def co_input_pairs(tx_out: DataFrame, tx_in: DataFrame, both_orders: bool = True) -> DataFrame:
    """Distinct (tx_id, input1, input2) of addresses spent together.

    The pairs are the result asked for. Repeated spends of an address are merged
    first, so that nothing but the result is produced; use
    :func:`co_input_links` where only the grouping matters.
    """
    inputs = tx_input_addresses(tx_out, tx_in)
    left = inputs.select("tx_id", F.col("address").alias("input1"))
    right = inputs.select("tx_id", F.col("address").alias("input2"))
    different = (
        F.col("input1") != F.col("input2") if both_orders else F.col("input1") < F.col("input2")
    )
    return left.join(right, "tx_id").filter(different)
