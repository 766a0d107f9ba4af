"""A ledger expressed over a star schema of orders, lines, parts and events.

Each table is a lazy DataFrame, so a query scans only the columns it uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Named ledger tables, each built on first use."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = builders
        self._tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._tables:
            if name not in self._builders:
                raise AttributeError(f"no ledger table {name}")
            self._tables[name] = self._builders[name]()
        return self._tables[name]

    @classmethod
    def of(cls, tables: dict[str, DataFrame]) -> "Ledger":
        return cls({name: (lambda df=df: df) for name, df in tables.items()})


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def derived_ledger(
    spark: SparkSession,
    folder: str,
    written: dict[str, Callable[[], DataFrame]] | None = None,
    scan: Callable[[str], DataFrame] | None = None,
) -> Ledger:
    """The ledger over the tables of ``folder``, or over what ``scan`` returns.

    Tables named in ``written`` are taken from there instead of being derived.
    """
    if scan is None:

        def scan(name: str) -> DataFrame:
            return spark.read.parquet(f"{folder}/{name}.parquet")

    def part_id() -> Column:
        return F.col("p_partkey")

    def tx() -> DataFrame:
        return scan("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("tx"), F.md5(F.col("o_orderkey").cast("string"))).alias("hash"),
            F.floor(F.col("o_orderkey") / 8).cast("long").alias("block_id"),
            F.round("o_totalprice").cast("long").alias("fee"),
        )

    def block() -> DataFrame:
        number = F.col("block_id")
        return (
            ledger.tx.groupBy("block_id")
            .agg(F.count("*").alias("tx_count"))
            .select(
                number.alias("id"),
                (number + 3).alias("block_no"),
                _text("blk", number).alias("hash"),
                F.floor(number / 4).cast("long").alias("epoch_no"),
                (number * 20).alias("slot_no"),
                "tx_count",
                (F.lit(788_918_400_000_000) + number * F.lit(108_000_000_000)).alias("time"),
                number.alias("slot_leader_id"),
            )
        )

    def slot_leader() -> DataFrame:
        key = F.col("c_custkey")
        return scan("customer").select(key.alias("id"), key.alias("pool_hash_id"))

    def pool_hash() -> DataFrame:
        return scan("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("view")
        )

    def stake_address() -> DataFrame:
        """Accounts that hold outputs, and others that only earn."""
        holders = scan("part").select(part_id().alias("id"), _text("stake", part_id()).alias("view"))
        key = F.col("s_suppkey")
        earners = scan("supplier").select((-1 - key).alias("id"), _text("earner", key).alias("view"))
        return holders.unionByName(earners)

    def outputs() -> DataFrame:
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        first = F.min(F.col("l_partkey") * 100 + F.col("l_suppkey")).cast("string")
        # first lines of neighbouring orders share a wallet, so that a transaction also
        # pays an address it spends from
        wallet = F.concat(F.lit("w"), F.floor(F.col("l_orderkey") / 16).cast("string"))
        own = (F.col("l_linenumber") == 1) & (F.min("l_partkey") % 3 == 0)
        first = F.when(own, wallet).otherwise(first)
        return (
            scan("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.concat(F.lit("addr"), first).alias("address"),
                F.concat(F.lit("raw"), first).alias("address_raw"),
                F.min("l_partkey").alias("stake_address_id"),
                F.min("l_suppkey").alias("supp"),
                F.sum(cents).alias("value"),
            )
            .select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                F.col("l_orderkey").alias("tx_id"),
                F.col("l_linenumber").alias("idx"),
                "address",
                "address_raw",
                "stake_address_id",
                "supp",
                "value",
            )
        )

    def tx_out() -> DataFrame:
        return ledger.outputs.drop("supp")

    def tx_in() -> DataFrame:
        spender = F.col("tx_id") + 1 + (F.col("stake_address_id") + F.col("idx")) % 11
        script_spend = F.when(F.col("stake_address_id") % 2 == 0, F.col("id"))
        return (
            ledger.outputs.filter(F.col("supp") % 4 != 0)
            .select(
                "id",
                spender.alias("tx_in_id"),
                F.col("tx_id").alias("tx_out_id"),
                F.col("idx").alias("tx_out_index"),
                script_spend.alias("redeemer_id"),
            )
            .join(ledger.tx.select(F.col("id").alias("tx_in_id")), "tx_in_id", "left_semi")
            .select("id", "tx_in_id", "tx_out_id", "tx_out_index", "redeemer_id")
        )

    def event_amount() -> Column:
        return F.round(F.col("value") * 1_000_000).cast("long").alias("amount")

    def reward() -> DataFrame:
        """Rewards of every event but sign-ups; purchases earn for accounts without outputs."""
        kind, user = F.col("event_type"), F.col("user_id")
        return (
            scan("events")
            .filter(kind != "signup")
            .select(
                F.col("event_id").alias("id"),
                F.when(kind == "purchase", -1 - user).otherwise(user).alias("addr_id"),
                F.when(kind != "error", user).alias("pool_id"),
                F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("earned_epoch"),
                event_amount(),
                F.when(kind == "view", "member")
                .when(kind == "purchase", "leader")
                .otherwise(kind)
                .alias("type"),
            )
        )

    def treasury() -> DataFrame:
        return (
            scan("events")
            .filter(F.col("event_type") == "signup")
            .select(
                F.col("event_id").alias("id"), F.col("user_id").alias("addr_id"), event_amount()
            )
        )

    def withdrawal() -> DataFrame:
        return ledger.outputs.filter(F.col("supp") % 4 == 1).select(
            "id",
            F.col("stake_address_id").alias("addr_id"),
            F.floor(F.col("value") / 100).cast("long").alias("amount"),
            "tx_id",
        )

    def redeemer() -> DataFrame:
        calls = ledger.tx_in.filter(F.col("redeemer_id").isNotNull()).select(
            "id", F.col("tx_in_id").alias("call_tx")
        )
        return ledger.outputs.join(calls, "id").select(
            "id",
            F.col("call_tx").alias("tx_id"),
            _text("script", F.col("stake_address_id")).alias("script_hash"),
            (F.col("value") % 1_000).alias("unit_mem"),
            (F.col("value") % 100_000).alias("unit_steps"),
            (F.col("value") % 10_000).alias("fee"),
            F.col("id").alias("datum_id"),
        )

    def script() -> DataFrame:
        kind = F.when(part_id() % 4 == 0, "plutus").otherwise("timelock")
        return scan("part").select(
            _text("script", part_id()).alias("hash"),
            (part_id() * 7).alias("tx_id"),
            kind.alias("type"),
        )

    def datum() -> DataFrame:
        return ledger.tx_in.filter(F.col("redeemer_id").isNotNull()).select(
            F.col("redeemer_id").alias("id"), F.col("tx_out_id").alias("tx_id")
        )

    def multi_asset() -> DataFrame:
        return scan("part").select(
            part_id().alias("id"),
            _text("asset", part_id()).alias("fingerprint"),
            F.col("p_brand").alias("policy"),
            _text("\\x", part_id()).alias("name"),
        )

    def ma_tx_mint() -> DataFrame:
        """A mint for every part of an order; even parts are minted and burnt one by one."""
        ident = F.col("l_partkey")
        amount = F.sum(F.col("l_quantity").cast("long"))
        quantity = (
            F.when((ident % 2 == 0) & (F.min("l_linenumber") % 2 == 0), F.lit(-1).cast("long"))
            .when(ident % 2 == 0, F.lit(1).cast("long"))
            .when(F.min("l_returnflag") == "R", -amount)
            .otherwise(amount)
        )
        return (
            scan("lineitem")
            .groupBy(F.col("l_orderkey").alias("tx_id"), ident)
            .agg(quantity.alias("quantity"))
            .select("tx_id", ident.alias("ident"), "quantity")
        )

    def ma_tx_out() -> DataFrame:
        """Two holdings of each output: its own asset, and one its block has in common."""
        output = F.col("id").alias("tx_out_id")
        own = ledger.outputs.select(
            output,
            F.col("stake_address_id").alias("ident"),
            (F.col("value") % 97 + 1).alias("quantity"),
        )
        shared = ledger.outputs.filter(F.col("idx") == 2).select(
            output,
            F.floor(F.col("tx_id") / 16).cast("long").alias("ident"),
            (F.col("value") % 89 + 1).alias("quantity"),
        )
        return own.unionByName(shared)

    def tx_metadata() -> DataFrame:
        order = F.col("o_orderkey").alias("tx_id")
        urgent = F.col("o_orderpriority")
        by_priority = (
            scan("orders")
            .filter(urgent.isin("1-URGENT", "2-HIGH"))
            .select(
                order, F.when(urgent == "1-URGENT", 721).otherwise(674).cast("long").alias("key")
            )
        )
        every_seventh = (
            scan("orders")
            .filter(F.col("o_orderkey") % 7 == 0)
            .select(order, F.lit(20).cast("long").alias("key"))
        )
        return by_priority.unionByName(every_seventh)

    builders = [
        tx, block, slot_leader, pool_hash, stake_address, outputs, tx_out, tx_in, reward,
        treasury, withdrawal, redeemer, script, datum, multi_asset, ma_tx_mint, ma_tx_out,
        tx_metadata,
    ]
    ledger = Ledger({builder.__name__: builder for builder in builders} | (written or {}))
    return ledger
