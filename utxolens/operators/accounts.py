"""Account totals and balances by stake address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.functions.amounts import ada, ada_sum, long_sum, wide_sum
from utxolens.operators.utxo import spent_outputs


def account_received(tx_out: DataFrame) -> DataFrame:
    return tx_out.groupBy("stake_address_id").agg(long_sum("value").alias("value"))


def account_spent(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Spent totals, over outputs made by a known transaction."""
    known = tx.select(F.col("id").alias("tx_id"))
    return (
        spent_outputs(tx_out.select("tx_id", "idx", "stake_address_id", "value"), tx_in)
        .join(known, "tx_id", "left_semi")
        .groupBy("stake_address_id")
        .agg(long_sum("value").alias("value"))
    )


def account_rewards(reward: DataFrame) -> DataFrame:
    return reward.groupBy("addr_id").agg(long_sum("amount").alias("amount"))


def account_withdrawals(withdrawal: DataFrame) -> DataFrame:
    return withdrawal.groupBy("addr_id").agg(long_sum("amount").alias("amount"))


def account_totals(
    tx: DataFrame,
    tx_in: DataFrame,
    tx_out: DataFrame,
    reward: DataFrame,
    withdrawal: DataFrame,
    stake_address: DataFrame,
    as_coded: bool = False,
) -> DataFrame:
    """received + rewards - spent - withdrawals of every account, in lovelace.

    Accounts found in only one of the four tables are kept; ``as_coded`` keeps
    only those that have received something. The four signed totals are stacked
    and added in one pass instead of being joined to each other.
    """

    def signed(df: DataFrame, key: str, amount: str, sign: int, received: int) -> DataFrame:
        return df.select(
            F.col(key).alias("account"),
            (F.col(amount) * sign).alias("amount"),
            F.lit(received).alias("received"),
        )

    parts = (
        signed(account_received(tx_out), "stake_address_id", "value", 1, 1)
        .unionByName(
            signed(account_spent(tx, tx_in, tx_out), "stake_address_id", "value", -1, 0)
        )
        .unionByName(signed(account_rewards(reward), "addr_id", "amount", 1, 0))
        .unionByName(signed(account_withdrawals(withdrawal), "addr_id", "amount", -1, 0))
    )
    totals = (
        parts.filter(F.col("account") != 0)
        .groupBy("account")
        .agg(wide_sum("amount").alias("balance"), F.max("received").alias("received"))
    )
    if as_coded:
        totals = totals.filter(F.col("received") == 1)
    names = stake_address.select(F.col("id").alias("account"), "view")
    return totals.join(names, "account", "left").select(
        F.col("account").alias("input_stake_address"),
        "view",
        F.col("balance").cast("long").alias("lovelace"),
    )


def account_balance(totals: DataFrame) -> DataFrame:
    """:func:`account_totals` in ADA."""
    return totals.select(
        "input_stake_address", "view", ada("lovelace").alias("account_balance_ADA")
    )


def _largest(totals: DataFrame, k: int) -> DataFrame:
    return totals.orderBy(F.col("lovelace").desc(), "input_stake_address").limit(k)


def top_balances(totals: DataFrame, k: int = 10) -> DataFrame:
    return _largest(totals, k).select("view", ada("lovelace").alias("account_balance_ADA"))


def top_balances_sum(totals: DataFrame, k: int = 10) -> DataFrame:
    return _largest(totals, k).agg(ada_sum("lovelace").alias("top_balances_sum"))


def total_balance(totals: DataFrame) -> DataFrame:
    return totals.agg(ada_sum("lovelace").alias("total_balance"))


def stake_totals(
    stake_address: DataFrame,
    unspent: DataFrame,
    reward_edges: DataFrame,
    treasury_edges: DataFrame,
    withdrawal_edges: DataFrame,
) -> DataFrame:
    """Each stake address with utxo, total_rewards, total_treasuries and
    total_withdrawals; null where it has none."""
    names = ["utxo", "total_rewards", "total_treasuries", "total_withdrawals"]

    def part(df: DataFrame, amount: str, name: str) -> DataFrame:
        totals = df.groupBy("stake_address_id").agg(wide_sum(amount).alias(name))
        blank = F.lit(None).cast("decimal(38,0)")
        return totals.select(
            "stake_address_id",
            *[F.col(n).cast("decimal(38,0)") if n == name else blank.alias(n) for n in names],
        )

    parts = part(unspent, "value", "utxo")
    for df, amount, name in [
        (reward_edges, "amount", "total_rewards"),
        (treasury_edges, "amount", "total_treasuries"),
        (withdrawal_edges, "value", "total_withdrawals"),
    ]:
        parts = parts.unionByName(part(df, amount, name))
    totals = parts.groupBy("stake_address_id").agg(*[long_sum(n).alias(n) for n in names])
    accounts = stake_address.select(F.col("id").alias("stake_address_id"), "view")
    return accounts.join(totals, "stake_address_id", "left")


def stake_balance_case(totals: DataFrame) -> DataFrame:
    """Balance of every stake address. Where withdrawals exceed rewards, both are
    left out of it."""
    utxo, rewards, treasuries, withdrawals = (
        F.coalesce(name, F.lit(0))
        for name in ("utxo", "total_rewards", "total_treasuries", "total_withdrawals")
    )
    net = rewards - withdrawals
    balance = F.when(net < 0, utxo + treasuries).when(net >= 0, utxo + treasuries + net)
    return totals.select(F.col("view").alias("stake_address"), balance.alias("balance"))
