"""Metrics of the entity network at many cut-offs, carried from one to the next.

The first cut-off builds everything; a later one works on what has changed since the one
before. Entities that merge hand over their addresses, balance and links as totals, only
entities that are taken apart are worked out from their outputs again. Histograms of
sizes, balances and degrees lose the old cells of the changed entities and gain their
new ones; counts, core and Gini index follow from the histograms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.functions.amounts import wide_sum
from utxolens.operators.network_metrics import core_of, output_lifetimes, unspent_at, wealth_of
from utxolens.sources.storage import WorkTables
from utxolens.streaming.entity_state import EntityChange, change_entities

BEFORE_ALL = -(2**62)  # earlier than any block
ENTITY = "entity_id"


@dataclass(frozen=True)
class Totals:
    """A table with a row per entity, and how many entities have each value of a column."""

    rows: DataFrame
    cells: DataFrame  # (value, count)
    column: str

    def carried(self, work: WorkTables, changed: DataFrame, new_rows: DataFrame) -> Totals:
        """With ``new_rows`` in place of the rows of the ``changed`` entities (entity_id)."""
        old_rows = self.rows.join(changed, ENTITY, "left_semi")
        moved = old_rows.select(F.col(self.column).alias("value"), F.lit(-1).alias("count")).unionByName(
            new_rows.select(F.col(self.column).alias("value"), F.lit(1).alias("count"))
        )
        cells = (
            self.cells.unionByName(moved)
            .groupBy("value")
            .agg(F.sum("count").alias("count"))
            .filter("count != 0")
        )
        rows = self.rows.join(changed, ENTITY, "left_anti").unionByName(new_rows)
        return replace(
            self,
            rows=work.write(rows.select(*self.rows.columns), self.column),
            cells=work.write(cells, f"{self.column}-cells"),
        )


@dataclass(frozen=True)
class State:
    """What is carried from a cut-off to the next."""

    cut_off: int
    entity: DataFrame
    members: DataFrame
    numbers: DataFrame  # (address, nr)
    edges: DataFrame  # (src, dst)
    sizes: Totals
    balances: Totals
    degrees: Totals


def _nothing(lifetimes: DataFrame) -> State:
    one = lifetimes.select(
        "address", "tx_id", F.col("id").alias("nr"), F.col("id").alias(ENTITY),
        F.col("id").alias("src"), F.col("id").alias("dst"), F.col("id").alias("value"),
        *[F.lit(0).cast("long").alias(c) for c in ("count", "addresses", "balance", "in_degree", "out_degree", "degree")],
    ).limit(0)
    cells = one.select("value", "count")
    return State(
        BEFORE_ALL,
        one.select("address", ENTITY),
        one.select("tx_id", "address"),
        one.select("address", "nr"),
        one.select("src", "dst"),
        Totals(one.select(ENTITY, "addresses"), cells, "addresses"),
        Totals(one.select(ENTITY, "balance"), cells, "balance"),
        Totals(one.select(ENTITY, "in_degree", "out_degree", "degree"), cells, "degree"),
    )


def _since(column: str, state: State, cut_off: int) -> Column:
    return (F.col(column) > state.cut_off) & (F.col(column) <= cut_off)


def _ids(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [table.select(ENTITY) for table in tables]).distinct()


def _lifted(rows: DataFrame, chosen: DataFrame, change: EntityChange) -> DataFrame:
    """Rows of the chosen entities that were not taken apart, by the entity they are in now."""
    into = change.merges.select(F.col("id").alias(ENTITY), "component")
    return (
        rows.join(chosen, ENTITY, "left_semi")
        .join(change.broken, ENTITY, "left_anti")
        .join(into, ENTITY, "left")
        .withColumn(ENTITY, F.coalesce("component", ENTITY))
        .drop("component")
    )


def _sizes(state: State, change: EntityChange, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    added = fresh.groupBy(ENTITY).agg(F.count("*").alias("addresses"))
    both = _lifted(state.sizes.rows, touched, change).unionByName(added)
    return both.groupBy(ENTITY).agg(F.sum("addresses").alias("addresses"))


def _balance_changes(
    state: State, change: EntityChange, fresh: DataFrame, lifetimes: DataFrame, cut_off: int
) -> tuple[DataFrame, DataFrame]:
    """(entity_id, balance): what entities gained since the last cut-off, and what the
    addresses have that are new or whose entity was taken apart."""
    counted = F.when(unspent_at(cut_off), F.col("value")).otherwise(0)
    earlier = F.when(unspent_at(state.cut_off), F.col("value")).otherwise(0)
    moving = lifetimes.filter(
        (F.col("created_block") <= cut_off)
        & ((F.col("created_block") > state.cut_off) | (F.col("spent_block") >= state.cut_off))
    )
    gained = (
        moving.groupBy("address")
        .agg(wide_sum(counted - earlier).alias("balance"))
        .filter("balance != 0")
        .join(fresh.select("address"), "address", "left_anti")
        .join(change.entity, "address")
        .groupBy(ENTITY)
        .agg(F.sum("balance").cast("long").alias("balance"))
    )
    own = (
        lifetimes.filter(F.col("created_block") <= cut_off)
        .join(fresh, "address")
        .groupBy(ENTITY)
        .agg(wide_sum(counted).cast("long").alias("balance"))
    )
    return gained, own


def _links_of(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Ends of the unordered pairs of ``edges`` that no kept edge has."""
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    turned = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    alone = pairs.join(kept, ["src", "dst"], "left_anti").join(turned, ["src", "dst"], "left_anti")
    return alone.select(F.explode(F.array("src", "dst")).alias(ENTITY))


def _edge_changes(
    state: State, change: EntityChange, spends: DataFrame, new_txs: DataFrame, work: WorkTables
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, gone, added) edges: those untouched, those at an entity that has another
    name now or was taken apart, and those that the new names and transactions make."""
    renamed = change.merges.filter("id != component").join(
        change.broken.withColumnRenamed(ENTITY, "id"), "id", "left_anti"
    )
    hit = work.write(
        renamed.select(F.col("id").alias("end"), F.col("component").alias("into")).unionByName(
            change.broken.select(F.col(ENTITY).alias("end"), F.lit(None).cast("long").alias("into"))
        ),
        "hit",
    )
    marked = state.edges
    for end in ("src", "dst"):
        named = hit.select(F.col("end").alias(end), F.col("into").alias(f"{end}_into"), F.lit(True).alias(f"{end}_hit"))
        marked = marked.join(named, end, "left")
    marked = work.write(marked, "marked")
    untouched = F.col("src_hit").isNull() & F.col("dst_hit").isNull()
    kept, gone = marked.filter(untouched).select("src", "dst"), marked.filter(~untouched)
    whole = [F.col(f"{end}_hit").isNull() | F.col(f"{end}_into").isNotNull() for end in ("src", "dst")]
    moved = gone.filter(whole[0] & whole[1]).select(
        F.coalesce("src_into", "src").alias("src"), F.coalesce("dst_into", "dst").alias("dst")
    )
    of_loose = spends.join(change.loose, "address", "left_semi")
    txs = work.write(
        new_txs.unionByName(of_loose.select("tx_id"))
        .unionByName(of_loose.filter(F.col("spent_in").isNotNull()).select(F.col("spent_in").alias("tx_id")))
        .distinct(),
        "txs",
    )
    inputs = spends.filter(F.col("spent_in").isNotNull()).select(F.col("spent_in").alias("tx_id"), "address")

    def ends(rows: DataFrame, name: str) -> DataFrame:
        chosen = rows.select("tx_id", "address").join(txs, "tx_id", "left_semi").distinct()
        return chosen.join(change.entity, "address").select("tx_id", F.col(ENTITY).alias(name)).distinct()

    paid = ends(inputs, "src").join(ends(spends, "dst"), "tx_id").select("src", "dst")
    added = (
        moved.unionByName(paid)
        .filter(F.col("src") != F.col("dst"))
        .distinct()
        .join(kept, ["src", "dst"], "left_anti")
    )
    return kept, gone.select("src", "dst"), work.write(added, "added")


def _degree_changes(kept: DataFrame, gone: DataFrame, added: DataFrame) -> DataFrame:
    """(entity_id, in_degree, out_degree, degree) that edges take away and add."""
    none = F.lit(0).cast("long")
    parts = []
    for edges, sign in ((gone, -1), (added, 1)):
        one = F.lit(sign).cast("long")
        parts += [
            edges.select(F.col("dst").alias(ENTITY), one.alias("in_degree"), none.alias("out_degree"), none.alias("degree")),
            edges.select(F.col("src").alias(ENTITY), none.alias("in_degree"), one.alias("out_degree"), none.alias("degree")),
            _links_of(edges, kept).select(ENTITY, none.alias("in_degree"), none.alias("out_degree"), one.alias("degree")),
        ]
    return _summed(reduce(DataFrame.unionByName, parts))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(ENTITY).agg(*[F.sum(c).alias(c) for c in ("in_degree", "out_degree", "degree")])


def advance(state: State, lifetimes: DataFrame, tx: DataFrame, cut_off: int) -> State:
    """The state at a later cut-off. ``lifetimes`` is a stored table of
    :func:`output_lifetimes`, with the outputs of all blocks."""
    work = WorkTables(lifetimes.sparkSession, "snapshot-series")
    spent = F.when(F.col("spent_block") <= cut_off, F.col("spent_in"))
    spends = lifetimes.filter(F.col("created_block") <= cut_off).select(
        "id", "tx_id", "address", "value", spent.alias("spent_in")
    )
    new_txs = tx.filter(_since("block_id", state, cut_off)).select(F.col("id").alias("tx_id"))
    spent_since = lifetimes.filter(
        _since("spent_block", state, cut_off) & (F.col("created_block") <= cut_off)
    ).select("tx_id")
    unknown = (
        lifetimes.filter(_since("created_block", state, cut_off))
        .groupBy("address")
        .agg(F.min("id").alias("nr"))
        .join(state.numbers, "address", "left_anti")
    )
    unknown = work.write(unknown, "numbers")
    numbers = state.numbers.unionByName(unknown)
    touched_txs = new_txs.unionByName(spent_since).distinct()
    change = change_entities(state.entity, state.members, spends, touched_txs, numbers, unknown)

    new = change.loose.unionByName(change.unknown.select("address"))
    fresh = work.write(change.entity.join(new, "address", "left_semi").select("address", ENTITY), "fresh")
    met = change.merges.select(F.col("id").alias(ENTITY))
    touched = work.write(_ids(change.broken, met), "touched")
    sizes = work.write(_sizes(state, change, fresh, touched), "sizes")

    gained, own = _balance_changes(state, change, fresh, lifetimes, cut_off)
    gained = work.write(gained, "gained")
    moving = work.write(_ids(touched, gained), "moving")
    nothing = fresh.select(ENTITY, F.lit(0).cast("long").alias("balance"))
    balances = (
        _lifted(state.balances.rows, moving, change)
        .unionByName(gained)
        .unionByName(own)
        .unionByName(nothing)
        .groupBy(ENTITY)
        .agg(F.sum("balance").alias("balance"))
    )

    kept, gone, added = _edge_changes(state, change, spends, new_txs, work)
    changes = work.write(_degree_changes(kept, gone, added), "degree-changes")
    linked = work.write(_ids(touched, changes), "linked")
    zeros = sizes.select(ENTITY, *[F.lit(0).cast("long").alias(c) for c in ("in_degree", "out_degree", "degree")])
    left = touched.join(sizes.select(ENTITY), ENTITY, "left_anti")
    degrees = _summed(
        state.degrees.rows.join(linked, ENTITY, "left_semi").unionByName(changes).unionByName(zeros)
    ).join(left, ENTITY, "left_anti")

    return State(
        cut_off,
        change.entity,
        change.members,
        numbers,
        work.write(kept.unionByName(added), "edges"),
        state.sizes.carried(work, touched, sizes),
        state.balances.carried(work, moving, work.write(balances, "balances")),
        state.degrees.carried(work, linked, work.write(degrees, "degrees")),
    )


def metrics(state: State) -> DataFrame:
    """One row (cut_off, no_ent, no_addr, largest_entity, links, core_length, gini_index,
    gini_index_no_zeros, average_wealth), from the histograms alone."""
    count = F.col("count")
    sizes = state.sizes.cells.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("no_ent"),
        F.coalesce(F.sum(F.col("value") * count), F.lit(0)).alias("no_addr"),
        F.max("value").alias("largest_entity"),
    )
    links = state.degrees.cells.agg(
        F.coalesce((F.sum(F.col("value") * count) / 2).cast("long"), F.lit(0)).alias("links")
    )
    core = core_of(state.degrees.cells.withColumnRenamed("value", "degree")).agg(
        F.max("core_length").alias("core_length")
    )
    wealth = wealth_of(state.balances.cells)
    return sizes.select(
        F.lit(state.cut_off).cast("long").alias("cut_off"),
        "no_ent",
        "no_addr",
        "largest_entity",
        links.scalar().alias("links"),
        core.scalar().alias("core_length"),
        *[wealth.select(c).scalar().alias(c) for c in ("gini_index", "gini_index_no_zeros", "average_wealth")],
    )


def states(tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, cut_offs: Sequence[int]) -> Iterator[State]:
    """The carried state at each cut-off, in rising order. Lives of outputs are worked out
    once, before the first."""
    work = WorkTables(tx.sparkSession, "snapshot-series")
    lifetimes = work.write(output_lifetimes(tx, tx_in, tx_out), "lifetimes")
    state = _nothing(lifetimes)
    for cut_off in sorted(cut_offs):
        state = advance(state, lifetimes, tx, cut_off)
        yield state


def snapshot_series(
    tx: DataFrame, tx_in: DataFrame, tx_out: DataFrame, cut_offs: Sequence[int]
) -> DataFrame:
    """:func:`metrics` at each cut-off."""
    rows = [metrics(state) for state in states(tx, tx_in, tx_out, cut_offs)]
    return reduce(DataFrame.unionByName, rows)
