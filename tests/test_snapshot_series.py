"""Metrics carried from cut-off to cut-off against a full rebuild at each."""

import pytest
from pyspark.sql import functions as F

from ledgers import random_book, rows
from utxolens.operators import entities, network_metrics
from utxolens.streaming import snapshot_series


def until(tx, tx_in, tx_out, cut_off):
    known = tx.filter(F.col("block_id") <= cut_off).select("id")
    outputs = tx_out.join(known.withColumnRenamed("id", "tx_id"), "tx_id", "left_semi").select(*tx_out.columns)
    inputs = tx_in.join(known.withColumnRenamed("id", "tx_in_id"), "tx_in_id", "left_semi").select(*tx_in.columns)
    return outputs, inputs


def test_each_state_equals_a_rebuild(spark):
    tx, tx_in, tx_out = random_book(31, transactions=60, addresses=30).tables(spark)
    lifetimes = network_metrics.output_lifetimes(tx, tx_in, tx_out)
    renamed = set()
    before = {}
    for state in snapshot_series.states(tx, tx_in, tx_out, [4, 9, 15]):
        outputs, inputs = until(tx, tx_in, tx_out, state.cut_off)
        entity = entities.entities(outputs, inputs)
        want = rows(entity.select("address", "entity_id"))
        assert rows(state.entity.select("address", "entity_id")) == want
        renamed |= {a for a, e in want if before.get(a, e) != e}
        before = dict(want)
        edges = entities.entity_edges(entity, outputs, inputs)
        assert rows(state.edges.select("src", "dst")) == rows(edges.select("src", "dst"))
        degrees = network_metrics.entity_degrees(entity, edges)
        columns = ["entity_id", "in_degree", "out_degree", "degree"]
        assert rows(state.degrees.rows.select(*columns)) == rows(degrees.select(*columns))
        balances = network_metrics.entity_balances(entity, lifetimes, state.cut_off)
        assert rows(state.balances.rows.select("entity_id", "balance")) == rows(balances)
        for totals, column in ((state.sizes, "addresses"), (state.balances, "balance"), (state.degrees, "degree")):
            cells = network_metrics.histogram(totals.rows, column)
            assert rows(totals.cells.select("value", "count")) == rows(cells)
        got = snapshot_series.metrics(state).first()
        counts = network_metrics.entity_counts(entity).first()
        assert (got.no_ent, got.no_addr) == (counts.no_ent, counts.no_addr)
        assert got.core_length == network_metrics.core_size(degrees).first().core_length
        wealth = network_metrics.wealth(balances).first()
        assert got.gini_index == pytest.approx(wealth.gini_index)
        assert got.gini_index_no_zeros == pytest.approx(wealth.gini_index_no_zeros)
        assert got.average_wealth == pytest.approx(wealth.average_wealth)
    assert renamed


def test_cut_offs_without_news(spark):
    """Nothing before the first block, and nothing new after the last."""
    tx, tx_in, tx_out = random_book(33, transactions=30).tables(spark)
    found = snapshot_series.snapshot_series(tx, tx_in, tx_out, [100, -1, 50]).collect()
    assert [r.cut_off for r in found] == [-1, 50, 100]
    assert (found[0].no_ent, found[0].no_addr, found[0].links) == (0, 0, 0) and found[0].gini_index is None
    same = [{k: v for k, v in r.asDict().items() if k != "cut_off"} for r in found[1:]]
    assert same[0] == same[1] and found[1].no_ent > 0
