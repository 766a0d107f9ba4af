"""Clustering of addresses into entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.functions.hot_keys import DEAL, dealt, join_back
from utxolens.operators.change import all_change, output_spends
from utxolens.operators.edges import neighbour_sets
from utxolens.operators.graph_algorithms import connected_components
from utxolens.operators.utxo import spent_outputs
from utxolens.sources.storage import WorkTables


def cluster_members(spends: DataFrame, change: DataFrame) -> DataFrame:
    """Distinct (tx_id, address) that one transaction shows to be of one owner:
    its inputs and its change, or its inputs if there is more than one.

    Change without an input cannot occur: each rule asks for inputs.
    """
    # made distinct at the end, where a transaction's rows lie together already
    inputs = spends.filter(F.col("spent_in").isNotNull()).select(
        F.col("spent_in").alias("tx_id"), "address"
    )
    changed = spends.select(F.col("id").alias("out_id"), "address").join(change, "out_id")
    every = inputs.unionByName(changed.select("tx_id", "address"))
    # counted from the rows themselves, which need not be grouped by address first
    uses = spends.select(F.col("spent_in").alias("tx_id")).filter(F.col("tx_id").isNotNull())
    enough = (
        uses.unionByName(changed.select("tx_id"))
        .groupBy("tx_id")
        .agg(F.count("*").alias("all_uses"))
        .filter(F.col("all_uses") > 1)
    )
    return (
        join_back(every, enough, "tx_id", how="left_semi", keep=True)
        .select("tx_id", "address", DEAL)
        .distinct()
        .drop(DEAL)
    )


def other_outputs(spends: DataFrame, change: DataFrame) -> DataFrame:
    """Outputs that are not change and stand alone."""
    return spends.join(change.select(F.col("out_id").alias("id")), "id", "left_anti")


def address_numbers(spends: DataFrame) -> DataFrame:
    """(address, nr): the id of the first output of each address."""
    return spends.groupBy("address").agg(F.min("id").alias("nr"))


def member_links(members: DataFrame, numbers: DataFrame) -> DataFrame:
    """Members of a transaction linked to its smallest one, by address number."""
    # without the filter only one of the two plans that read this would have it
    present = numbers.filter(F.col("nr").isNotNull())
    numbered = members.join(present, "address").select("tx_id", "nr")
    centre = numbered.groupBy("tx_id").agg(F.min("nr").alias("dst"))
    return (
        join_back(numbered, centre, "tx_id")
        .filter(F.col("nr") != F.col("dst"))
        .select(F.col("nr").alias("src"), "dst")
    )


def assign_entities(numbers: DataFrame, links: DataFrame) -> DataFrame:
    """(address, entity_id). The id is the smallest number in the entity, that is
    the id of its first output; an unlinked address is an entity of its own."""
    components = connected_components(links)
    return numbers.join(components.withColumnRenamed("id", "nr"), "nr", "left").select(
        "address", F.coalesce("component", "nr").alias("entity_id")
    )


def entities(tx_out: DataFrame, tx_in: DataFrame, as_coded: bool = False) -> DataFrame:
    """Every address with its entity.

    Transactions without inputs only add their outputs. All outputs of an address
    belong to its entity. Outputs meet their spends once; the rules, the members
    and the numbers all read that narrow table.
    """
    work = WorkTables(tx_out.sparkSession, "entities")
    spends = work.write(output_spends(tx_out, tx_in), "spends")
    numbers = work.write(address_numbers(spends), "numbers")
    change = work.write(all_change(spends, as_coded), "change")
    members = work.write(cluster_members(spends, change), "members")
    return assign_entities(numbers, member_links(members, numbers))


def entity_nodes(entity: DataFrame, tx_out: DataFrame) -> DataFrame:
    """(entity_id, tx_id, idx) of every output."""
    return tx_out.select("tx_id", "idx", "address").join(entity, "address").select(
        "entity_id", "tx_id", "idx"
    )


def entity_edges(entity: DataFrame, tx_out: DataFrame, tx_in: DataFrame) -> DataFrame:
    """Distinct (src, dst) of different entities with a payment between them.

    Addresses are replaced by entities once, before outputs meet their spends and inputs
    meet outputs. The inputs of a transaction are nearly always one entity, so the join
    stays linear.
    """
    work = WorkTables(tx_out.sparkSession, "entity-edges")
    nodes = work.write(entity_nodes(entity, tx_out), "nodes")
    sources = (
        spent_outputs(nodes, tx_in)
        .select(F.col("spent_in").alias("tx_id"), F.col("entity_id").alias("src"))
        .distinct()
    )
    targets = nodes.select("tx_id", F.col("entity_id").alias("dst")).distinct()
    return (
        sources.join(targets, "tx_id")
        .filter(F.col("src") != F.col("dst"))
        .select("src", "dst")
        .distinct()
    )


def transaction_documents(
    tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, part_size: int = 10_000
) -> DataFrame:
    """Transactions with nested ``inputs`` and ``outputs``.

    The rows of an unusually large transaction are spread over several parts of
    about ``part_size`` rows, so that no row grows without bound. Each list is
    null where the transaction has none.
    """
    output = F.struct("id", "tx_id", "idx", "address", "value")
    spent = spent_outputs(tx_out, tx_in).select(
        F.col("spent_in").alias("id"), F.lit("in").alias("side"), output.alias("output")
    )
    made = tx_out.select(
        F.col("tx_id").alias("id"), F.lit("out").alias("side"), output.alias("output")
    )
    # counted from the narrow tables; repeated rows go where the lists are made
    uses = tx_in.select(F.col("tx_in_id").alias("id")).unionByName(tx_out.select(F.col("tx_id").alias("id")))
    sizes = uses.groupBy("id").agg(F.count("*").alias("rows"))
    parts = F.ceil(F.col("rows") / part_size)
    nested = (
        join_back(spent.unionByName(made), sizes, "id", keep=True)
        .withColumn("part", F.pmod(F.xxhash64("output.id"), parts))
        # a transaction's rows lie together already, unless it is a hot one that was split
        .groupBy("id", DEAL, "part")
        .agg(
            F.collect_set(F.when(F.col("side") == "in", F.col("output"))).alias("inputs"),
            F.collect_set(F.when(F.col("side") == "out", F.col("output"))).alias("outputs"),
        )
    )
    filled = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("inputs", "outputs")]
    # the lists stay where they are, the transactions come to them
    return (
        dealt(tx, "id")
        .join(nested, ["id", DEAL], "left")
        .select(*tx.columns, F.coalesce("part", F.lit(0)).alias("part"), *filled)
    )


def entity_documents(entity: DataFrame, part_size: int = 120_000) -> DataFrame:
    """Entities with their addresses nested, in parts of about ``part_size``."""
    return neighbour_sets(entity, "entity_id", "address", part_size).withColumnRenamed(
        "neighbours", "addresses"
    )
