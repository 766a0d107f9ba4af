"""Structured Streaming jobs: each drains what is new and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.operators.edges import id_edges
from utxolens.operators.rewards import ada_rewards_by_type
from utxolens.operators.tokens import merge_token_supply, token_supply
from utxolens.operators.utxo import network_by_id, new_addresses, outputs_by_id
from utxolens.functions.ranking import dense_ids
from utxolens.sources.sinks import append_batch, overwrite, write_edges
from utxolens.sources.storage import materialize
from utxolens.schemas import ddl
from utxolens.streaming.incremental import network_increment, stored_table



def drain(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str = "append",
) -> None:
    """Handle everything available, one micro-batch at a time, then stop.

    A micro-batch that failed comes again under the same id; the sinks replace
    what it wrote before.
    """
    query = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each_batch)
        .start()
    )
    query.awaitTermination()


def network_feed(
    tx_in_stream: DataFrame, tx: DataFrame, tx_out: DataFrame, target: str, checkpoint: str
) -> None:
    """Append the network rows that arriving inputs bring.

    New inputs are joined to all outputs, old ones too. Inputs of one transaction
    may arrive in several batches; rows an earlier batch has stored are left out.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        earlier = stored_table(batch.sparkSession, target, f"{ddl('transaction_network')}, batch_id bigint")
        earlier = earlier.filter(F.col("batch_id") < batch_id).drop("batch_id")
        network = network_increment(
            {"tx": tx.limit(0), "tx_in": batch, "tx_out": tx_out.limit(0)},
            tx,
            batch,
            tx_out,
            earlier,
        )
        append_batch(network, target, batch_id)

    drain(tx_in_stream, each_batch, checkpoint)


def token_supply_feed(mint_stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append the supply of each batch of mints; see :func:`read_token_supply`."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        append_batch(token_supply(batch), target, batch_id)

    drain(mint_stream, each_batch, checkpoint)


def read_token_supply(parts: DataFrame) -> DataFrame:
    """Totals over the parts written by :func:`token_supply_feed`."""
    parts = parts.select("ident", "quantity", "cnt", "mtx")
    return merge_token_supply(parts, parts.limit(0))


def reward_type_feed(reward_stream: DataFrame, target: str, checkpoint: str) -> None:
    """Keep the totals by type up to date; the state is one row per type."""

    def each_batch(totals: DataFrame, batch_id: int) -> None:
        overwrite(totals, target)

    drain(ada_rewards_by_type(reward_stream), each_batch, checkpoint, "complete")


def address_feed(output_stream: DataFrame, target: str, checkpoint: str) -> None:
    """Give each new address the next free id and append it."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        # a retried batch must not see its own rows
        known = stored_table(batch.sparkSession, target, f"{ddl('addresses')}, batch_id bigint")
        known = known.filter(F.col("batch_id") < batch_id).select("id", "address")
        last = known.agg(F.max("id")).first()[0] or 0
        fresh = new_addresses(batch, known)
        append_batch(
            dense_ids(fresh, "address", last_id=last).select("id", "address"), target, batch_id
        )

    drain(output_stream, each_batch, checkpoint)


def edge_feed(
    tx_in_stream: DataFrame,
    tx: DataFrame,
    tx_out: DataFrame,
    addresses: DataFrame,
    root: str,
    checkpoint: str,
) -> None:
    """Append the transfer edges, by address id, of the inputs that arrive.

    Outputs get the ids of their addresses once, those without are left out, so the edges
    of a batch have both ends. A stored edge can only equal one of its own transaction.
    """
    nodes = materialize(
        outputs_by_id(tx_out, addresses).filter(F.col("address_id").isNotNull()), "nodes"
    )

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        network = network_by_id(tx, batch, nodes, chosen=True)
        touched = batch.select(F.col("tx_in_id").alias("tx_id")).distinct()
        write_edges(id_edges(network), None, root, "TRANSACTED_WITH", batch_id, group=touched)

    drain(tx_in_stream, each_batch, checkpoint)
