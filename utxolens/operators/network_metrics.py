"""Measures of the entity network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utxolens.functions.amounts import long_sum, wide_sum
from utxolens.functions.ranking import counts_before
from utxolens.sources.storage import materialize

# Fixed value: added to every balance before the Gini index is taken.
GINI_EPSILON = 1e-7


def entity_degrees(entity: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, in_degree, out_degree, degree); degree counts distinct neighbours.

    Entities without edges have zeros.
    """
    sides = edges.select(
        F.col("src").alias("entity_id"), F.col("dst").alias("other"), F.lit(1).alias("out"),
        F.lit(0).alias("in"),
    ).unionByName(
        edges.select(
            F.col("dst").alias("entity_id"), F.col("src").alias("other"), F.lit(0).alias("out"),
            F.lit(1).alias("in"),
        )
    )
    counted = (
        sides.groupBy("entity_id", "other")
        .agg(F.max("in").alias("in"), F.max("out").alias("out"))
        .groupBy("entity_id")
        .agg(
            F.sum("in").alias("in_degree"),
            F.sum("out").alias("out_degree"),
            F.count("*").alias("degree"),
        )
    )
    return (
        entity.select("entity_id")
        .distinct()
        .join(counted, "entity_id", "left")
        .na.fill(0, ["in_degree", "out_degree", "degree"])
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def degree_histogram(degrees: DataFrame) -> DataFrame:
    """(kind, value, count) for in-, out- and total degree."""
    kinds = F.explode(
        F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))
                for kind, column in [("in", "in_degree"), ("out", "out_degree"), ("total", "degree")]
            ]
        )
    )
    return (
        degrees.select(kinds.alias("d"))
        .groupBy(F.col("d.kind").alias("kind"), F.col("d.value").alias("value"))
        .agg(F.count("*").alias("count"))
    )


def histogram_map(hist: DataFrame, value: str = "value", count: str = "count") -> DataFrame:
    """A histogram as one map row. For degrees, which take few distinct values."""
    entry = F.struct(F.col(value).cast("string"), F.col(count))
    return hist.agg(F.map_from_entries(F.collect_list(entry)).alias("distribution"))


def output_lifetimes(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame) -> DataFrame:
    """Outputs with ``created_block`` and ``spent_block`` (null while unspent), and with
    the transactions that made (``tx_id``) and spent them (``spent_in``).

    A spend by an unknown transaction gives ``spent_block`` null with
    ``has_spend`` true.
    """
    made = tx.select(F.col("id").alias("tx_id"), F.col("block_id").alias("created_block"))
    spenders = tx.select(F.col("id").alias("tx_in_id"), F.col("block_id").alias("spent_block"))
    spends = tx_in.select(
        "tx_in_id", F.col("tx_out_id").alias("tx_id"), F.col("tx_out_index").alias("idx")
    ).join(spenders, "tx_in_id", "left")
    # spends first: what a reader asks of them is filtered before the blocks are looked up
    return (
        tx_out.select("id", "tx_id", "idx", "address", "value")
        .join(spends, ["tx_id", "idx"], "left")
        .join(made, "tx_id")
        .select(
            "id",
            "tx_id",
            "address",
            "value",
            F.col("tx_in_id").alias("spent_in"),
            "created_block",
            "spent_block",
            F.col("tx_in_id").isNotNull().alias("has_spend"),
        )
    )


def unspent_at(cut_off: Column | int) -> Column:
    """Output counts at ``cut_off``: made by then, and unspent or spent in that
    block or later."""
    cut_off = cut_off if isinstance(cut_off, Column) else F.lit(cut_off)
    return (F.col("created_block") <= cut_off) & (
        ~F.col("has_spend") | (F.col("spent_block") >= cut_off)
    )


def entity_balances(entity: DataFrame, lifetimes: DataFrame, cut_off: Column | int) -> DataFrame:
    """(entity_id, balance) in lovelace at a block; 0 for entities with nothing."""
    # outputs that do not count add nothing, so they need not be moved
    counted = lifetimes.filter(unspent_at(cut_off))
    by_address = counted.groupBy("address").agg(wide_sum("value").alias("balance"))
    return (
        entity.join(by_address, "address", "left")
        .groupBy("entity_id")
        .agg(F.coalesce(F.sum("balance").cast("long"), F.lit(0)).alias("balance"))
    )


def balance_series(lifetimes: DataFrame, entity: DataFrame, cut_offs: Sequence[int]) -> DataFrame:
    """(cut_off, entity_id, balance) for several blocks in one pass.

    An output adds its value at the first cut-off that counts it and takes it back
    at the first that no longer does, in a column for each cut-off; running totals of an
    entity's columns do the rest, so that an address is moved once for all cut-offs.
    """
    ordered = F.array(*[F.lit(c).cast("long") for c in sorted(cut_offs)])
    starts = F.size(F.filter(ordered, lambda c: c < F.col("created_block")))
    ends = F.size(F.filter(ordered, lambda c: c <= F.col("spent_block")))
    left = (
        F.when(~F.col("has_spend"), F.size(ordered))
        .when(F.col("spent_block").isNull(), starts)
        .otherwise(ends)
    )
    places = range(len(cut_offs))
    changes = [
        wide_sum(
            F.when(F.col("starts") == at, F.col("value")).when(F.col("left") == at, -F.col("value"))
        ).alias(f"change_{at}")
        for at in places
    ]
    by_address = (
        lifetimes.select("address", "value", starts.alias("starts"), left.alias("left"))
        # what no cut-off counts changes nothing
        .filter(F.col("starts") < F.col("left"))
        .groupBy("address")
        .agg(*changes)
    )
    totals = (
        entity.select("address", "entity_id")
        .join(by_address, "address", "left")
        .groupBy("entity_id")
        .agg(*[F.sum(f"change_{at}").alias(f"change_{at}") for at in places])
    )
    running, balances = F.lit(0).cast("decimal(38,0)"), []
    for at in places:
        running = (running + F.coalesce(f"change_{at}", F.lit(0))).cast("decimal(38,0)")
        balances.append(
            F.struct(F.element_at(ordered, at + 1).alias("cut_off"), running.cast("long").alias("balance"))
        )
    return totals.select(F.explode(F.array(*balances)).alias("at"), "entity_id").select(
        "at.cut_off", "entity_id", "at.balance"
    )


def wealth_of(hist: DataFrame) -> DataFrame:
    """One row (gini_index, gini_index_no_zeros, average_wealth, n) of a histogram (value,
    count), a stored table.

    A run of m equal values x with c values before it adds x * m * (2c + m - n) to the
    spread. Negative values are shifted to start at 0, and the epsilon keeps an all-zero
    input defined. Among the positive values alone, a run has as many values fewer before
    it as there are others, so both indices come from one ranking.
    """
    value, count = F.col("value").cast("decimal(38,0)"), F.col("count").cast("decimal(38,0)")
    ranked = counts_before(hist, "value", "count")
    n = hist.agg(F.sum("count")).scalar()
    others = hist.agg(F.coalesce(F.sum(F.when(F.col("value") <= 0, F.col("count"))), F.lit(0))).scalar()
    positive = F.col("value") > 0

    def spread(before: Column, size: Column) -> Column:
        run = (F.col("count") * (2 * before + F.col("count") - size)).cast("decimal(38,0)")
        return (value * run).cast("decimal(38,0)")

    sums = ranked.agg(
        F.sum(spread(F.col("before"), n)).alias("spread"),
        F.sum(F.when(positive, spread(F.col("before") - others, n - others))).alias("positive_spread"),
        F.sum((value * count).cast("decimal(38,0)")).alias("total"),
        F.sum(F.when(positive, (value * count).cast("decimal(38,0)"))).alias("positive_total"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("n"),
        F.sum(F.when(positive, F.col("count"))).alias("positive_n"),
        F.least(F.min("value"), F.lit(0)).alias("shift"),
    )
    size, few = F.col("n").cast("double"), F.col("positive_n").cast("double")
    total = (
        F.col("total").cast("double") - size * F.col("shift").cast("double") + size * GINI_EPSILON
    )
    positive_total = F.col("positive_total").cast("double") + few * GINI_EPSILON
    return sums.select(
        F.when(size > 0, F.col("spread").cast("double") / (size * total)).alias("gini_index"),
        (F.col("positive_spread").cast("double") / (few * positive_total)).alias("gini_index_no_zeros"),
        F.when(size > 0, F.col("total").cast("double") / size).alias("average_wealth"),
        "n",
    )


def gini_index(balances: DataFrame, column: str = "balance") -> DataFrame:
    """One row (gini_index, n): Gini index of the values of a column."""
    return wealth_of(materialize(histogram(balances, column), "histogram")).select("gini_index", "n")


def wealth(balances: DataFrame) -> DataFrame:
    """One row (gini_index, gini_index_no_zeros, average_wealth), from one histogram."""
    return wealth_of(materialize(histogram(balances, "balance"), "histogram")).drop("n")


def core_histogram(degrees: DataFrame, column: str = "degree") -> DataFrame:
    """(degree, count, core_count, core_length): how many entities of each degree
    are in the core.

    Entities are taken in falling degree. Adding the k-th (from 0) changes the
    distance to a perfect core by k - 1 - degree, so the best k is the last one
    with k <= degree. In a run of equal degrees after ``before`` others that is
    the smaller of the degree and the last place of the run.
    """
    hist = degrees.groupBy(F.col(column).alias("degree")).agg(F.count("*").alias("count"))
    return core_of(materialize(hist, "histogram"))


def core_of(hist: DataFrame) -> DataFrame:
    """:func:`core_histogram` of a histogram (degree, count), a stored table."""
    ranked = counts_before(hist, "degree", "count", descending=True)
    last = F.least(F.col("before") + F.col("count") - 1, F.col("degree"))
    best = ranked.agg(F.max(F.when(F.col("before") <= F.col("degree"), last))).scalar()
    inside = F.greatest(F.lit(0), F.least(best - F.col("before"), F.col("count")))
    return ranked.select(
        "degree",
        "count",
        inside.cast("long").alias("core_count"),
        best.cast("long").alias("core_length"),
    )


def core_size(degrees: DataFrame) -> DataFrame:
    """One row (core_length, total_entities)."""
    return core_histogram(degrees).agg(
        F.max("core_length").alias("core_length"), F.sum("count").alias("total_entities")
    )


def core_description(degrees: DataFrame) -> DataFrame:
    """(degree, count) of the entities in the core."""
    return (
        core_histogram(degrees)
        .filter(F.col("core_count") > 0)
        .select("degree", F.col("core_count").alias("count"))
    )


def entity_counts(entity: DataFrame) -> DataFrame:
    """One row (no_ent, no_addr)."""
    sizes = entity.groupBy("entity_id").agg(F.count("*").alias("addresses"))
    return sizes.agg(
        F.count("*").alias("no_ent"), F.coalesce(F.sum("addresses"), F.lit(0)).alias("no_addr")
    )


def addresses_per_entity(entity: DataFrame) -> DataFrame:
    """(value, count): how many entities have that many addresses."""
    sizes = entity.groupBy("entity_id").agg(F.count("*").alias("addresses"))
    return histogram(sizes, "addresses")


def series_ratios(counts: DataFrame, core: DataFrame, scc: DataFrame) -> DataFrame:
    """Addresses per entity, core share and share of the largest strongly
    connected component in percent, for the snapshots found in all three."""
    return (
        counts.join(core.select("snapshot_ts", "core_length"), "snapshot_ts")
        .join(scc.select("snapshot_ts", "scc_size"), "snapshot_ts")
        .select(
            "snapshot_ts",
            (F.col("no_addr") / F.col("no_ent")).alias("addresses_per_entity"),
            (F.col("core_length") / F.col("no_ent")).alias("core_share"),
            (F.col("scc_size") / F.col("no_ent") * 100).alias("scc_percent"),
        )
    )


def activity_totals(entity: DataFrame) -> DataFrame:
    """Largest and smallest entity id."""
    return entity.agg(F.max("entity_id").alias("max_id"), F.min("entity_id").alias("min_id"))


def total_of(df: DataFrame, column: str) -> DataFrame:
    return df.agg(long_sum(column).alias("total"))
