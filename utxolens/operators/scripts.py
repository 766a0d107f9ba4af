"""Smart-contract calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.functions.amounts import LOVELACE_PER_ADA, ada_sum, day_text, long_sum


def script_calls(
    tx: DataFrame,
    redeemer: DataFrame,
    tx_in: DataFrame,
    tx_out: DataFrame,
    block: DataFrame,
    as_coded: bool = False,
) -> DataFrame:
    """Totals per script over all of its calls, and the earliest calling block.

    Every redeemer counts, whatever its purpose. Blocks are found by ``block.id``;
    ``as_coded`` looks them up by ``block_no`` instead.
    """
    calls = redeemer.select(
        F.col("id").alias("redeemer_id"),
        F.col("tx_id").alias("call_tx"),
        "script_hash",
        "unit_mem",
        "unit_steps",
        "fee",
    )
    spends = tx_in.filter(F.col("redeemer_id").isNotNull()).select(
        "redeemer_id",
        F.col("tx_out_id").alias("tx_id"),
        F.col("tx_out_index").alias("idx"),
    )
    blocks = block.select(
        F.col("block_no" if as_coded else "id").alias("block_id"),
        "block_no",
        day_text("time").alias("date"),
        F.col("hash").alias("block_hash"),
    )
    txs = tx.select(F.col("id").alias("call_tx"), "block_id")
    outputs = tx_out.select("tx_id", "idx", "value")
    first = F.min(F.struct("block_no", "date", "block_hash"))
    return (
        calls.join(spends, "redeemer_id")
        .join(outputs, ["tx_id", "idx"])
        .join(txs, "call_tx")
        .join(blocks, "block_id")
        .groupBy("script_hash")
        .agg(
            ada_sum("value").alias("tx_out_value"),
            long_sum("unit_mem").alias("tot_unit_mem"),
            long_sum("unit_steps").alias("tot_unit_steps"),
            ada_sum("fee").alias("total_fees"),
            first.alias("first_block"),
        )
        .select(
            "script_hash",
            "tx_out_value",
            "tot_unit_mem",
            "tot_unit_steps",
            "total_fees",
            F.col("first_block.date").alias("deployment_timestamp"),
            F.col("first_block.block_no").alias("block_no"),
            F.col("first_block.block_hash").alias("block_hash"),
        )
    )


def script_averages(calls: DataFrame, as_coded: bool = False) -> DataFrame:
    """Averages over scripts. ``as_coded`` divides the ADA amounts once more."""
    unit = F.lit(LOVELACE_PER_ADA if as_coded else 1)
    return calls.agg(
        (F.avg("total_fees") / unit).alias("ADA_avg_fees"),
        (F.avg("tx_out_value") / unit).alias("ADA_avg_value"),
        F.avg("tot_unit_mem").alias("avg_unit_mem"),
        F.avg("tot_unit_steps").alias("avg_unit_steps"),
    )


def scripts_per_block(calls: DataFrame) -> DataFrame:
    return calls.groupBy("block_no").agg(F.count("*").alias("cnt_sc"))


def scripts_by_date(calls: DataFrame) -> DataFrame:
    return calls.groupBy("deployment_timestamp").agg(F.count("*").alias("nr_sc_created"))
