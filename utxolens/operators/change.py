"""Change-address rules. Each returns (tx_id, out_id): the output that is change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.functions.hot_keys import DEAL, join_back
from utxolens.sources.storage import materialize


def output_spends(tx_out: DataFrame, tx_in: DataFrame) -> DataFrame:
    """(id, tx_id, address, value, spent_in): every output and who spends it, if anyone.

    All rules read this one table. An output is spent at most once.
    """
    spends = tx_in.select(
        F.col("tx_out_id").alias("tx_id"),
        F.col("tx_out_index").alias("idx"),
        F.col("tx_in_id").alias("spent_in"),
    )
    return tx_out.join(spends, ["tx_id", "idx"], "left").select(
        "id", "tx_id", "address", "value", "spent_in"
    )


def transaction_shapes(spends: DataFrame) -> DataFrame:
    """(tx_id, n_inputs, n_outputs, least_input) of transactions with any of them."""
    sides = F.explode(
        F.array(
            F.struct(
                F.col("tx_id").alias("tx_id"),
                F.lit(0).alias("input"),
                F.lit(1).alias("output"),
                F.lit(None).cast("long").alias("value"),
            ),
            F.struct(
                F.col("spent_in").alias("tx_id"),
                F.lit(1).alias("input"),
                F.lit(0).alias("output"),
                F.col("value").alias("value"),
            ),
        )
    )
    return (
        spends.select(sides.alias("side"))
        .select("side.*")
        .filter(F.col("tx_id").isNotNull())
        .groupBy("tx_id")
        .agg(
            F.sum("input").alias("n_inputs"),
            F.sum("output").alias("n_outputs"),
            F.min("value").alias("least_input"),
        )
    )


def change_reuse(spends: DataFrame) -> DataFrame:
    """Exactly one address is on both sides: its first output is change."""
    sides = F.explode(
        F.array(
            F.struct(F.col("tx_id").alias("tx_id"), F.col("id").alias("out_id"), F.lit(False).alias("input")),
            F.struct(
                F.col("spent_in").alias("tx_id"), F.lit(None).cast("long").alias("out_id"), F.lit(True).alias("input")
            ),
        )
    )
    return (
        spends.select("address", sides.alias("side"))
        .select("address", "side.*")
        .filter(F.col("tx_id").isNotNull())
        .groupBy("tx_id", "address")
        .agg(F.min("out_id").alias("out_id"), F.max("input").alias("input"))
        .filter(F.col("input") & F.col("out_id").isNotNull())
        .groupBy("tx_id")
        .agg(F.count("*").alias("shared"), F.min("out_id").alias("out_id"))
        .filter(F.col("shared") == 1)
        .select("tx_id", "out_id")
    )


def change_optimal(spends: DataFrame, shapes: DataFrame, as_coded: bool = False) -> DataFrame:
    """Several inputs and outputs, and exactly one output below the least input.

    ``as_coded`` accepts more than one such output and takes the second by id.
    """
    several = shapes.filter((F.col("n_inputs") > 1) & (F.col("n_outputs") > 1))
    low = (
        join_back(
            spends.select("id", "tx_id", "value"),
            several.select("tx_id", "least_input"),
            "tx_id",
            keep=True,
        )
        .filter(F.col("value") < F.col("least_input"))
        .select("tx_id", DEAL, "id")
    )
    # a transaction's rows lie together already
    first = low.groupBy("tx_id", DEAL).agg(F.count("*").alias("n"), F.min("id").alias("out_id"))
    if not as_coded:
        return first.filter(F.col("n") == 1).select("tx_id", "out_id")
    second = (
        join_back(low, first.select("tx_id", "out_id"), "tx_id")
        .filter(F.col("id") > F.col("out_id"))
        .groupBy("tx_id")
        .agg(F.min("id").alias("second_id"))
    )
    return first.join(second, "tx_id", "left").select(
        "tx_id", F.coalesce("second_id", "out_id").alias("out_id")
    )


def change_peeling(spends: DataFrame, shapes: DataFrame) -> DataFrame:
    """One input and two outputs, and the spender of an output looks the same.

    If both outputs qualify, the later one is change.
    """
    one_in_two_out = shapes.filter(
        (F.col("n_inputs") == 1) & (F.col("n_outputs") == 2)
    ).select("tx_id")
    return (
        join_back(
            join_back(spends.select("id", "tx_id", "spent_in"), one_in_two_out, "tx_id", how="left_semi"),
            one_in_two_out.withColumnRenamed("tx_id", "spent_in"),
            "spent_in",
            how="left_semi",
        )
        .groupBy("tx_id")
        .agg(F.max("id").alias("out_id"))
    )


def change_final(reuse: DataFrame, optimal: DataFrame, peeling: DataFrame) -> DataFrame:
    """Transactions on which all the rules that fired agree."""
    return (
        reuse.unionByName(optimal)
        .unionByName(peeling)
        .groupBy("tx_id")
        .agg(F.min("out_id").alias("out_id"), F.max("out_id").alias("other"))
        .filter(F.col("out_id") == F.col("other"))
        .select("tx_id", "out_id")
    )


def all_change(spends: DataFrame, as_coded: bool = False) -> DataFrame:
    """The three rules and their combination, over :func:`output_spends`.

    Two rules read the shapes, each other columns, so those that any rule asks for are
    worked out once and written.
    """
    asked_for = (F.col("n_inputs") > 0) & (F.col("n_outputs") > 1)
    shapes = materialize(transaction_shapes(spends).filter(asked_for), "shapes")
    return change_final(
        change_reuse(spends),
        change_optimal(spends, shapes, as_coded),
        change_peeling(spends, shapes),
    )
