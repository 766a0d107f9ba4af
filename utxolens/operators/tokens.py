"""Token supply, kinds and creation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.functions.amounts import day_text, long_sum

# Fixed value: the metadata key that marks a non-fungible token.
NFT_KEY = 721


def token_supply(ma_tx_mint: DataFrame) -> DataFrame:
    """Minted quantity, number of mints and first transaction of each token."""
    return ma_tx_mint.groupBy("ident").agg(
        long_sum("quantity").alias("quantity"),
        F.count("*").alias("cnt"),
        F.min("tx_id").alias("mtx"),
    )


def merge_token_supply(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Supply after an increment: partial totals of a token are added up."""
    return (
        stored.unionByName(delta)
        .groupBy("ident")
        .agg(
            long_sum("quantity").alias("quantity"),
            F.sum("cnt").alias("cnt"),
            F.min("mtx").alias("mtx"),
        )
    )


def token_types(
    supply: DataFrame,
    multi_asset: DataFrame,
    tx: DataFrame,
    tx_metadata: DataFrame,
    block: DataFrame,
) -> DataFrame:
    """Tokens with their asset record, metadata key and creation date.

    A token whose first transaction carries several metadata keys has one row
    for each of them.
    """
    assets = multi_asset.select(F.col("id").alias("ident"), "fingerprint", "policy", "name")
    txs = tx.select(F.col("id").alias("mtx"), "block_id")
    keys = tx_metadata.select(F.col("tx_id").alias("mtx"), "key")
    blocks = block.select(F.col("id").alias("block_id"), day_text("time").alias("date_created"))
    return (
        supply.join(assets, "ident", "left")
        .join(txs, "mtx", "left")
        .join(keys, "mtx", "left")
        .join(blocks, "block_id", "left")
        .select(
            "fingerprint",
            "key",
            "policy",
            "name",
            "ident",
            F.col("cnt").alias("mints"),
            F.col("quantity").alias("total_supply"),
            "date_created",
        )
    )


def _by_day(types: DataFrame, distinct_tokens: bool) -> DataFrame:
    if distinct_tokens:
        types = types.select("date_created", "ident").distinct()
    return types.groupBy("date_created").agg(F.count("*").alias("tokens_created_count"))


def tokens_by_day(types: DataFrame, distinct_tokens: bool = False) -> DataFrame:
    """Rows of ``types`` by creation day, or tokens with ``distinct_tokens``."""
    return _by_day(types, distinct_tokens)


def nfts_by_day(types: DataFrame, distinct_tokens: bool = False) -> DataFrame:
    return _by_day(types.filter(F.col("key") == NFT_KEY), distinct_tokens)


def fts_by_day(types: DataFrame, distinct_tokens: bool = False) -> DataFrame:
    """Like :func:`nfts_by_day` for other keys; tokens without a key are in neither."""
    return _by_day(types.filter(~F.col("key").isin(NFT_KEY)), distinct_tokens)


def tokens_by_supply(types: DataFrame) -> DataFrame:
    supply = F.col("total_supply")
    return (
        types.filter((supply > 0) & (supply != 1))
        .groupBy(supply.alias("token_supply"))
        .agg(F.count("*").alias("token_count"))
        .orderBy("token_supply")
    )


def tokens_unique_supply(types: DataFrame) -> DataFrame:
    supply = F.col("total_supply")
    return (
        types.filter((supply > 0) & (supply == 1))
        .groupBy(supply.alias("token_supply"))
        .agg(F.count("*").alias("tokens_count_tot_supply"))
        .orderBy("token_supply")
    )
