"""Entities carried from one increment to the next, and snapshots of their network."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utxolens.operators import network_metrics
from utxolens.operators.change import (
    change_final,
    change_optimal,
    change_peeling,
    change_reuse,
    output_spends,
    transaction_shapes,
)
from utxolens.operators.entities import (
    address_numbers,
    cluster_members,
    entities,
    entity_edges,
    member_links,
)
from utxolens.operators.graph_algorithms import connected_components, largest_scc
from utxolens.sources.sinks import upsert_snapshot
from utxolens.sources.storage import WorkTables
from utxolens.streaming.incremental import log_run


def touched_transactions(spends: DataFrame, new_txs: DataFrame) -> DataFrame:
    """(tx_id) of new transactions and of those with an output that one of them
    spends, whose peeling decision may now be another."""
    earlier = spends.join(
        new_txs.select(F.col("tx_id").alias("spent_in")), "spent_in", "left_semi"
    ).select("tx_id")
    return new_txs.select("tx_id").unionByName(earlier).distinct()


def members_of(spends: DataFrame, touched: DataFrame) -> DataFrame:
    """Cluster members of the touched transactions, from the rows they need."""
    spenders = (
        spends.join(touched, "tx_id", "left_semi")
        .filter(F.col("spent_in").isNotNull())
        .select(F.col("spent_in").alias("tx_id"))
    )
    scope = touched.unionByName(spenders).distinct()
    as_output = spends.join(scope, "tx_id", "left_semi").select(*spends.columns)
    as_input = spends.join(
        scope.withColumnRenamed("tx_id", "spent_in"), "spent_in", "left_semi"
    ).select(*spends.columns)
    # one row per output id, whichever side brought it in; all the rules read it
    work = WorkTables(spends.sparkSession, "touched-rows")
    rows = work.write(as_output.unionByName(as_input).dropDuplicates(["id"]), "rows")
    shapes = transaction_shapes(rows).join(scope, "tx_id", "left_semi")
    change = work.write(
        change_final(
            change_reuse(rows), change_optimal(rows, shapes), change_peeling(rows, shapes)
        ).join(touched, "tx_id", "left_semi"),
        "change",
    )
    return cluster_members(rows, change).join(touched, "tx_id", "left_semi")


@dataclass(frozen=True)
class EntityChange:
    """Entities after some transactions, and what has changed for it."""

    entity: DataFrame  # (address, entity_id)
    members: DataFrame  # (tx_id, address)
    merges: DataFrame  # (id, component) of entities and new numbers that met
    broken: DataFrame  # (entity_id) of entities taken apart
    loose: DataFrame  # (address) of their addresses
    unknown: DataFrame  # (address, nr) of new addresses


def change_entities(
    stored: DataFrame,
    stored_members: DataFrame,
    spends: DataFrame,
    touched: DataFrame,
    own: DataFrame,
    unknown: DataFrame,
) -> EntityChange:
    """Entities and members after ``touched`` transactions, equal to a full rebuild.

    Stored entities stand for all of their addresses, so components run on the
    entities that the touched transactions connect. Only where a transaction no
    longer shows what it did are the entities of its members taken apart and built
    again from their own transactions. ``own`` (address, nr) has the numbers of all
    addresses, ``unknown`` those of the addresses not stored yet.
    """
    work = WorkTables(spends.sparkSession, "entity-update")
    touched = work.write(touched, "touched")
    fresh = work.write(members_of(spends, touched), "fresh")
    before = stored_members.join(touched, "tx_id", "left_semi").select("tx_id", "address")
    withdrawn = before.join(fresh, ["tx_id", "address"], "left_anti")
    members = work.write(
        stored_members.join(touched, "tx_id", "left_anti")
        .select("tx_id", "address")
        .unionByName(fresh),
        "members",
    )

    broken = work.write(
        withdrawn.select("address").distinct().join(stored, "address").select("entity_id").distinct(),
        "broken",
    )
    loose = work.write(stored.join(broken, "entity_id", "left_semi").select("address"), "loose")
    unknown = work.write(unknown.select("address", "nr"), "unknown")
    base = work.write(
        stored.join(broken, "entity_id", "left_anti")
        .select("address", F.col("entity_id").alias("nr"))
        .unionByName(own.join(loose, "address", "left_semi").select("address", "nr"))
        .unionByName(unknown),
        "base",
    )
    rebuild = (
        members.join(loose, "address", "left_semi").select("tx_id").unionByName(touched).distinct()
    )
    links = member_links(members.join(rebuild, "tx_id", "left_semi"), base)
    merges = work.write(connected_components(links), "merges")
    after = base.join(merges.withColumnRenamed("id", "nr"), "nr", "left").select(
        "address", F.coalesce("component", "nr").alias("entity_id")
    )
    return EntityChange(work.write(after, "entities"), members, merges, broken, loose, unknown)


def update_entities(
    stored: DataFrame, stored_members: DataFrame, spends: DataFrame, new_txs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Entities and members after ``new_txs``: :func:`change_entities` where nothing but
    the entities and members of the transactions before is at hand."""
    own = address_numbers(spends)
    unknown = own.join(stored, "address", "left_anti")
    touched = touched_transactions(spends, new_txs)
    found = change_entities(stored, stored_members, spends, touched, own, unknown)
    return found.entity, found.members


def snapshot_cut_offs(block: DataFrame, months: int = 4) -> DataFrame:
    """(snapshot_ts, cut_off): ends of windows of some months from the first block
    on, each with the last block before it. A block exactly on an end belongs to
    the next window. The last end lies after the last block.
    """
    at = F.timestamp_micros("time")
    step = F.make_ym_interval(F.lit(0), F.lit(months))
    ends = block.agg(F.min(at).alias("first"), F.max(at).alias("last")).select(
        F.sequence(F.col("first") + step, F.col("last") + step, step).alias("ends")
    )
    month = lambda time: F.year(time) * 12 + F.month(time)
    end = lambda nr: F.col("_end") + F.make_ym_interval(F.lit(0), nr * months)
    # a block's window follows from its calendar month, whatever the number of windows:
    # the end that falls on a month not after its own may still lie ahead within that month
    near = F.floor((month(at) - month("_end")) / months).cast("int")
    last_in_window = (
        block.withColumn("_end", ends.select(F.element_at("ends", 1)).scalar())
        .withColumn("_near", near)
        .withColumn("_passed", F.col("_near") + F.when(end(F.col("_near")) <= at, 1).otherwise(0))
        .select(end(F.col("_passed")).alias("snapshot_ts"), "id")
        .groupBy("snapshot_ts")
        .agg(F.max("id").alias("last_id"))
    )
    # one row per window from here on
    up_to = Window.orderBy("snapshot_ts").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ends.select(F.explode("ends").alias("snapshot_ts"))
        .join(last_in_window, "snapshot_ts", "left")
        .select("snapshot_ts", F.max("last_id").over(up_to).alias("cut_off"))
    )


def snapshot_metrics(
    spark: SparkSession,
    snapshot_ts,
    cut_off: int,
    tx: DataFrame,
    tx_in: DataFrame,
    tx_out: DataFrame,
    folder: str,
) -> None:
    """Work out and store every metric of the ledger up to ``cut_off``."""
    started = time.time()
    work = WorkTables(spark, "snapshot")
    known = tx.filter(F.col("block_id") <= cut_off)
    outputs = tx_out.join(known.select(F.col("id").alias("tx_id")), "tx_id", "left_semi").select(
        *tx_out.columns
    )
    inputs = tx_in.join(
        known.select(F.col("id").alias("tx_in_id")), "tx_in_id", "left_semi"
    ).select(*tx_in.columns)
    entity = work.write(entities(outputs, inputs), "entities")
    edges = work.write(entity_edges(entity, outputs, inputs), "edges")
    degrees = work.write(network_metrics.entity_degrees(entity, edges), "degrees")
    lifetimes = network_metrics.output_lifetimes(tx, tx_in, tx_out)
    balances = work.write(network_metrics.entity_balances(entity, lifetimes, cut_off), "balances")

    def store(df: DataFrame, name: str) -> None:
        stamped = df.withColumn("snapshot_ts", F.lit(snapshot_ts).cast("timestamp"))
        upsert_snapshot(stamped, f"{folder}/{name}")
        log_run(spark, f"{folder}/run_log", "snapshot", name, started, time.time())

    store(network_metrics.entity_counts(entity), "entity_counts")
    store(network_metrics.addresses_per_entity(entity), "addresses_per_entity")
    store(network_metrics.degree_histogram(degrees), "degree_histogram")
    store(largest_scc(edges), "scc")
    store(network_metrics.core_size(degrees), "core")
    store(network_metrics.core_description(degrees), "core_description")
    store(network_metrics.wealth(balances), "balances")


def full_state(tx_out: DataFrame, tx_in: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and members from scratch, to start or to check the carried state."""
    work = WorkTables(tx_out.sparkSession, "entity-state")
    spends = work.write(output_spends(tx_out, tx_in), "spends")
    txs = (
        spends.select("tx_id")
        .unionByName(spends.select(F.col("spent_in").alias("tx_id")))
        .filter(F.col("tx_id").isNotNull())
        .distinct()
    )
    nobody = spends.select("address", F.col("id").alias("entity_id")).limit(0)
    nothing = spends.select("tx_id", "address").limit(0)
    return update_entities(nobody, nothing, spends, txs)
