"""Questions asked of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.functions.amounts import ada
from utxolens.functions.hot_keys import join_back
from utxolens.operators.utxo import input_edges, network_edges, output_edges


def network_edge_table(
    tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, chosen: bool = False
) -> DataFrame:
    """The whole network: every transfer edge with its hash and amounts."""
    return network_edges(tx, tx_in, tx_out, chosen).select(
        F.col("input_addr").alias("src"),
        F.col("output_addr").alias("dst"),
        "tx_hash",
        ada("input_value").alias("ADA_Input"),
        ada("output_value").alias("ADA_Output"),
    )


def network_table(
    tx_in: DataFrame,
    tx_out: DataFrame,
    tx: DataFrame,
    stake_payments: DataFrame,
    stake_address: DataFrame,
) -> DataFrame:
    """(from, to, amount) over address transfers and stake payments, no repeats."""
    inputs = input_edges(tx_out, tx_in).select(
        "tx_id", F.col("address").alias("from"), F.col("amount").alias("value")
    )
    outputs = output_edges(tx_out, tx).select("tx_id", F.col("address").alias("to")).distinct()
    between_addresses = (
        inputs.join(outputs, "tx_id")
        .filter(F.col("from") != F.col("to"))
        .select("from", "to", ada("value").alias("amount"))
    )
    names = stake_address.select(F.col("id").alias("stake_address_id"), F.col("view").alias("from"))
    from_stakes = stake_payments.join(names, "stake_address_id").select(
        "from", F.col("address").alias("to"), F.col("ADA_Input").alias("amount")
    )
    return between_addresses.unionByName(from_stakes).distinct()


def script_network(
    tx: DataFrame,
    tx_in: DataFrame,
    tx_out: DataFrame,
    script: DataFrame,
    script_type: str | None = None,
) -> DataFrame:
    """Transfer edges of transactions that include a script, of one type if given.

    Transactions are cut down before the inputs and outputs are paired.
    """
    if script_type is not None:
        script = script.filter(F.col("type") == script_type)
    chosen = tx.join(script.select(F.col("tx_id").alias("id")), "id", "left_semi")
    return network_edge_table(chosen, tx_in, tx_out, chosen=True)


def tx_by_hash(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, tx_hash: str) -> DataFrame:
    """Inputs and outputs of one transaction, without repeats."""
    edges = network_edges(tx.filter(F.col("hash") == tx_hash), tx_in, tx_out, chosen=True)
    return edges.select(
        F.col("input_addr").alias("Inputs"),
        ada("input_value").alias("ADA_Input"),
        F.col("output_addr").alias("Outputs"),
        ada("output_value").alias("ADA_Output"),
    )


def token_transactions(token_rows: DataFrame) -> DataFrame:
    """Transfer edges that carry at least one token, with how many they carry."""
    return token_rows.groupBy("src", "dst", "tx_hash", "ADA_Input", "ADA_Output").agg(
        F.count("*").alias("tokens")
    )


def address_degrees(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Transfer edges leaving and entering each address.

    An input row of a transaction makes one edge to each of its outputs held by
    another address. That is a product of counts, so the edges themselves are
    never produced and a transaction of any size costs its own rows only.
    """
    one, none = F.lit(1).alias("ins"), F.lit(0).alias("ins")
    ends = (
        input_edges(tx_out, tx_in)
        .select("tx_id", "address", one, F.lit(0).alias("outs"))
        .unionByName(output_edges(tx_out, tx).select("tx_id", "address", none, F.lit(1).alias("outs")))
        .groupBy("tx_id", "address")
        .agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"))
    )
    totals = ends.groupBy("tx_id").agg(
        F.sum("ins").alias("all_ins"), F.sum("outs").alias("all_outs")
    )
    return (
        join_back(ends, totals, "tx_id")
        .groupBy("address")
        .agg(
            F.sum(F.col("ins") * (F.col("all_outs") - F.col("outs"))).alias("out_degree"),
            F.sum(F.col("outs") * (F.col("all_ins") - F.col("ins"))).alias("in_degree"),
        )
        .withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    )


def top_by_degree(degrees: DataFrame, column: str, k: int = 15) -> DataFrame:
    """The ``k`` addresses with the largest value in one of the degree columns."""
    return (
        degrees.filter(F.col(column) > 0)
        .select("address", column)
        .orderBy(F.col(column).desc(), "address")
        .limit(k)
    )


def latest_block(block: DataFrame) -> DataFrame:
    return block.agg(F.max("block_no").alias("latest_block"))


def latest_epoch(block: DataFrame) -> DataFrame:
    return block.agg(F.max("epoch_no").alias("latest_epoch"))


def pool_blocks_in_epoch(
    block: DataFrame, slot_leader: DataFrame, pool_hash: DataFrame, epoch: int, pool: str
) -> DataFrame:
    """Blocks one pool made in one epoch."""
    pools = pool_hash.filter(F.col("view") == pool).select(
        F.col("id").alias("pool_hash_id"), F.col("view").alias("pool_view")
    )
    leaders = slot_leader.select(F.col("id").alias("slot_leader_id"), "pool_hash_id")
    return (
        block.filter(F.col("epoch_no") == epoch)
        .join(leaders.join(pools, "pool_hash_id"), "slot_leader_id")
        .select("block_no", "epoch_no", "pool_view")
    )


def in_degrees(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))


def motif_mutual(pairs: DataFrame) -> DataFrame:
    """Pairs with edges in both directions, each in both orders.

    The two directions of a pair meet in one group of at most two rows.
    """
    low, high = F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")
    both = (
        pairs.filter(F.col("src") != F.col("dst"))
        .groupBy(low, high)
        .agg(
            F.max(F.col("src") < F.col("dst")).alias("up"),
            F.max(F.col("src") > F.col("dst")).alias("down"),
        )
        .filter(F.col("up") & F.col("down"))
    )
    orders = F.explode(
        F.array(
            F.struct(F.col("low").alias("a"), F.col("high").alias("b")),
            F.struct(F.col("high").alias("a"), F.col("low").alias("b")),
        )
    )
    return both.select(orders.alias("pair")).select("pair.a", "pair.b")


def edge_relationship_count(edges: DataFrame, relationship: str) -> DataFrame:
    return edges.filter(F.col("relationship") == relationship).agg(F.count("*").alias("count"))


def weighted_edges(pairs: DataFrame) -> DataFrame:
    """Source, target and weight of a network table for a drawing tool."""
    return pairs.select(
        F.col("input").alias("src"), F.col("output").alias("dst"), F.col("ADA_value").alias("weight")
    )


def both_directions(pairs: DataFrame) -> DataFrame:
    """Distinct (src, dst) of pairs and turned pairs: each node with its neighbours."""
    # each link is made distinct in one direction and turned afterwards
    rising = F.coalesce(F.col("src") <= F.col("dst"), F.col("src").isNull())
    links = pairs.select(
        F.when(rising, F.col("src")).otherwise(F.col("dst")).alias("low"),
        F.when(rising, F.col("dst")).otherwise(F.col("src")).alias("high"),
    ).distinct()
    there = F.struct(F.col("low").alias("src"), F.col("high").alias("dst"))
    back = F.struct(F.col("high").alias("src"), F.col("low").alias("dst"))
    ways = F.when(F.col("low").eqNullSafe(F.col("high")), F.array(there)).otherwise(F.array(there, back))
    return links.select(F.explode(ways).alias("way")).select("way.src", "way.dst")


def adjacency_sizes(pairs: DataFrame) -> DataFrame:
    """Number of neighbours of each node, in either direction."""
    both = both_directions(pairs)
    return both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("neighbours"))
