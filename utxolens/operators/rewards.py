"""Reward history and its totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utxolens.functions.amounts import ada_sum


def rewards_history(reward: DataFrame, stake_address: DataFrame, pool_hash: DataFrame) -> DataFrame:
    """Rewards with the names of the address and the pool they came from."""
    accounts = stake_address.select(F.col("id").alias("addr_id"), "view")
    pools = pool_hash.select(F.col("id").alias("pool_id"), F.col("view").alias("delegated_pool"))
    return (
        reward.join(pools, "pool_id")
        .join(accounts, "addr_id")
        .select(
            F.col("addr_id").alias("id"),
            "view",
            "earned_epoch",
            "delegated_pool",
            F.col("amount").alias("lovelace"),
        )
    )


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.col("earned_epoch").desc())


def reward_history_for_address(history: DataFrame, view: str) -> DataFrame:
    return (
        history.filter(F.col("view") == view)
        .select("earned_epoch", "delegated_pool", "lovelace")
        .orderBy("earned_epoch")
    )


def rewards_by_epoch(history: DataFrame) -> DataFrame:
    return history.groupBy("earned_epoch").agg(ada_sum("lovelace").alias("tot_ADA"))


def rewards_by_pool(history: DataFrame) -> DataFrame:
    return history.groupBy("delegated_pool").agg(ada_sum("lovelace").alias("tot_ADA"))


def distribution_whales(history: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` addresses with the largest rewards; ties go by name."""
    return (
        history.groupBy("view")
        .agg(ada_sum("lovelace").alias("tot_ADA"))
        .orderBy(F.col("tot_ADA").desc(), "view")
        .limit(k)
    )


def rewards_by_type(reward: DataFrame) -> DataFrame:
    return reward.groupBy("type").agg(F.count("*").alias("count"))


def ada_rewards_by_type(reward: DataFrame) -> DataFrame:
    return reward.groupBy("type").agg(ada_sum("amount").alias("ADA_amount"))


def pool_rewards_top(reward: DataFrame, pool_hash: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` pools with the largest rewards, totalled before the name join."""
    totals = reward.groupBy("pool_id").agg(ada_sum("amount").alias("total_rewards"))
    names = pool_hash.select(F.col("id").alias("pool_id"), "view")
    return (
        totals.join(names, "pool_id")
        .select(F.col("view").alias("pool_id"), "total_rewards")
        .orderBy(F.col("total_rewards").desc(), "pool_id")
        .limit(k)
    )


def staking_rewards_top(reward: DataFrame, stake_address: DataFrame, k: int = 15) -> DataFrame:
    totals = reward.groupBy("addr_id").agg(ada_sum("amount").alias("total_rewards"))
    names = stake_address.select(F.col("id").alias("addr_id"), "view")
    return (
        totals.join(names, "addr_id")
        .select(F.col("view").alias("stake_address"), "total_rewards")
        .orderBy(F.col("total_rewards").desc(), "stake_address")
        .limit(k)
    )


def _largest(df: DataFrame, key: str, amount: str, k: int) -> DataFrame:
    """The ``k`` largest amounts of each key; Spark cuts to ``k`` before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.col(amount).desc())
    return (
        df.withColumn("_nr", F.row_number().over(order)).filter(F.col("_nr") <= k).drop("_nr")
    )


def total_rewards_per_address(
    reward: DataFrame, treasury: DataFrame, stake_address: DataFrame, k: int = 15
) -> DataFrame:
    """Treasury payments, staking rewards, and the ``k`` largest sums of both.

    Three branches merged without repeats. The third adds each treasury amount of
    an address to each of its staking amounts. Its ``k`` largest sums lie in the
    ``k`` addresses with the best sum, and use only the ``k`` largest amounts of
    either side there, so no address is ever expanded to all of its pairs.
    """
    names = stake_address.select(F.col("id").alias("addr_id"), F.col("view").alias("stake_address"))
    paid = treasury.select("addr_id", F.col("amount").alias("treasury_reward"))
    earned = reward.select("addr_id", F.col("amount").alias("staking_reward"))
    columns = ["stake_address", "treasury_reward", "staking_reward", "total_rewards"]
    nothing = F.lit(None).cast("long")

    treasury_rows = (
        paid.distinct()
        .join(names, "addr_id")
        .withColumn("staking_reward", nothing)
        .withColumn("total_rewards", F.col("treasury_reward"))
        .select(columns)
    )
    staking_rows = (
        earned.distinct()
        .join(names, "addr_id")
        .withColumn("treasury_reward", nothing)
        .withColumn("total_rewards", F.col("staking_reward"))
        .select(columns)
    )
    best = (
        paid.groupBy("addr_id")
        .agg(F.max("treasury_reward").alias("best_paid"))
        .join(earned.groupBy("addr_id").agg(F.max("staking_reward").alias("best_earned")), "addr_id")
        .join(names, "addr_id")
        .orderBy((F.col("best_paid") + F.col("best_earned")).desc(), "stake_address")
        .limit(k)
        .select("addr_id", "stake_address")
    )
    chosen = F.broadcast(best)  # k rows
    sums = (
        _largest(paid.join(chosen, "addr_id"), "addr_id", "treasury_reward", k)
        .join(
            _largest(
                earned.join(chosen.select("addr_id"), "addr_id"), "addr_id", "staking_reward", k
            ),
            "addr_id",
        )
        .withColumn("total_rewards", F.col("treasury_reward") + F.col("staking_reward"))
        .select(columns)
        .orderBy(
            F.col("total_rewards").desc(), "stake_address", "treasury_reward", "staking_reward"
        )
        .limit(k)
    )
    return treasury_rows.unionByName(staking_rows).unionByName(sums).distinct()
