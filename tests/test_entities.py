import random

import pytest
from pyspark.sql import functions as F

from ledgers import Book, random_book, rows, union_find
from utxolens.operators import change, entities, network_metrics
from utxolens.operators.utxo import unspent_outputs
from utxolens.streaming import entity_state


def rules(spark, book, **options):
    _, tx_in, tx_out = book.tables(spark)
    spends = change.output_spends(tx_out, tx_in)
    shapes = change.transaction_shapes(spends)
    return (
        dict(rows(change.change_reuse(spends))),
        dict(rows(change.change_optimal(spends, shapes, **options))),
        dict(rows(change.change_peeling(spends, shapes))),
        dict(rows(change.all_change(spends))),
    )


def groups(spark, book):
    _, tx_in, tx_out = book.tables(spark)
    found = {}
    for address, entity in rows(entities.entities(tx_out, tx_in)):
        found.setdefault(entity, set()).add(address)
    return sorted(map(sorted, found.values()))


def paid(values, names="ABCDEFG"):
    """One transaction that gives each address its value."""
    return Book().pay(1, list(zip(names, values)))


def test_reused_address(spark):
    book = paid([10, 10]).pay(2, [("A", 11), ("C", 12)], [(1, 0), (1, 1)])
    reuse, optimal, _, final = rules(spark, book)
    assert (reuse, optimal, final) == ({2: 200}, {}, {2: 200})
    assert groups(spark, book) == [["A", "B"], ["C"]]


def test_two_reused_addresses_are_no_change(spark):
    reuse, *_ = rules(spark, paid([10, 10]).pay(2, [("A", 11), ("B", 12)], [(1, 0), (1, 1)]))
    assert reuse == {}


def test_reuse_takes_the_first_output(spark):
    book = paid([10, 10]).pay(2, [("C", 15), ("A", 15), ("A", 16)], [(1, 0), (1, 1)])
    assert rules(spark, book)[0] == {2: 201}


def test_optimal_change(spark):
    book = paid([10, 8]).pay(2, [("X", 3), ("Y", 15)], [(1, 0), (1, 1)])
    assert rules(spark, book)[1] == {2: 200}
    two_low = paid([10, 8]).pay(2, [("X", 3), ("Y", 5), ("Z", 10)], [(1, 0), (1, 1)])
    assert rules(spark, two_low)[1] == {}
    assert rules(spark, two_low, as_coded=True)[1] == {2: 201}


def test_rules_that_disagree_give_no_change(spark):
    book = paid([10, 8]).pay(2, [("A", 15), ("X", 3)], [(1, 0), (1, 1)])
    reuse, optimal, _, final = rules(spark, book)
    assert (reuse, optimal, final) == ({2: 200}, {2: 201}, {})


def peeling():
    return paid([100]).pay(2, [("X", 10), ("Y", 90)], [(1, 0)]).pay(3, [("Z", 20), ("W", 70)], [(2, 1)])


def test_peeling_chain(spark):
    assert rules(spark, peeling())[2] == {2: 201}
    both = peeling().pay(4, [("Q", 5), ("R", 5)], [(2, 0)])
    assert rules(spark, both)[2] == {2: 201}
    assert groups(spark, peeling()) == [["A", "Y"], ["W"], ["X"], ["Z"]]


def test_one_input_without_change_is_no_cluster(spark):
    assert groups(spark, paid([5]).pay(2, [("B", 5)], [(1, 0)])) == [["A"], ["B"]]


def test_entities_that_share_an_address_are_one(spark):
    book = paid([9, 9, 9, 9], "ABBC")
    book.pay(2, [("X", 18)], [(1, 0), (1, 1)]).pay(3, [("Y", 18)], [(1, 2), (1, 3)])
    assert groups(spark, book) == [["A", "B", "C"], ["X"], ["Y"]]


@pytest.mark.parametrize("seed", [2])
def test_entities_match_union_find(spark, seed):
    _, tx_in, tx_out = random_book(seed).tables(spark)
    spends = change.output_spends(tx_out, tx_in)
    members = rows(entities.cluster_members(spends, change.all_change(spends)))
    by_tx = {}
    for tx_id, address in members:
        by_tx.setdefault(tx_id, []).append(address)
    addresses = {r.address for r in tx_out.select("address").distinct().collect()}
    links = [(m[0], other) for m in by_tx.values() for other in m]
    want = union_find(links, addresses)
    got = dict(rows(entities.entities(tx_out, tx_in)))
    assert set(got) == addresses
    assert len(set(got.values())) == len(set(want.values()))
    assert len({(got[a], want[a]) for a in addresses}) == len(set(want.values()))


@pytest.mark.parametrize("seed, cuts", [(1, [20, 40])])
def test_carried_entities_equal_a_rebuild(spark, seed, cuts):
    _, tx_in, tx_out = random_book(seed).tables(spark)
    state = None
    low = 0
    for high in [*cuts, 60]:
        outputs, inputs = tx_out.filter(F.col("tx_id") <= high), tx_in.filter(F.col("tx_in_id") <= high)
        if state is None:
            state = entity_state.full_state(outputs, inputs)
        else:
            fresh = spark.range(low + 1, high + 1).withColumnRenamed("id", "tx_id")
            state = entity_state.update_entities(*state, change.output_spends(outputs, inputs), fresh)
        assert rows(state[0]) == rows(entities.entities(outputs, inputs))
        low = high


def test_a_withdrawn_link_is_taken_back(spark):
    """Transaction 2 reuses A; once its other output is peeled, the rules disagree."""
    before = paid([100]).pay(2, [("A", 10), ("Y", 90)], [(1, 0)])
    first = before.tables(spark)
    state = entity_state.full_state(first[2], first[1])
    after = before.pay(3, [("Z", 20), ("W", 70)], [(2, 1)])
    _, tx_in, tx_out = after.tables(spark)
    new = spark.createDataFrame([(3,)], "tx_id bigint")
    state = entity_state.update_entities(*state, change.output_spends(tx_out, tx_in), new)
    assert rows(state[0]) == rows(entities.entities(tx_out, tx_in))


def test_entity_edges_and_degrees(spark):
    book = paid([10, 10, 10]).pay(2, [("X", 20)], [(1, 0), (1, 1)]).pay(3, [("A", 10)], [(1, 2)])
    _, tx_in, tx_out = book.tables(spark)
    entity = entities.entities(tx_out, tx_in)
    names = dict(rows(entity))
    found = entities.entity_edges(entity, tx_out, tx_in)
    assert rows(found) == sorted([(names["A"], names["X"]), (names["C"], names["A"])])
    degrees = {r.entity_id: (r.in_degree, r.out_degree, r.degree) for r in network_metrics.entity_degrees(entity, found).collect()}
    assert degrees[names["A"]] == (1, 1, 2) and degrees[names["X"]] == (1, 0, 1)
    assert rows(network_metrics.entity_counts(entity)) == [(3, 4)]
    assert rows(network_metrics.addresses_per_entity(entity)) == [(1, 2), (2, 1)]
    nodes = entities.entity_nodes(entity, tx_out)
    assert nodes.filter(F.col("entity_id") == names["A"]).count() == 3


def test_documents(spark):
    tx, tx_in, tx_out = paid([10, 20]).pay(2, [("X", 30)], [(1, 0), (1, 1)]).tables(spark)
    found = {r.id: r for r in entities.transaction_documents(tx, tx_in, tx_out).collect()}
    assert found[1].inputs is None and len(found[1].outputs) == 2
    assert sorted(i.address for i in found[2].inputs) == ["A", "B"]
    wide = entities.transaction_documents(
        *Book().pay(1, [("A", v) for v in range(500)]).tables(spark), part_size=50
    ).collect()
    assert len(wide) > 5 and sum(len(r.outputs) for r in wide) == 500


def balances(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "entity_id bigint, balance bigint")


def test_gini(spark):
    def plain(values):
        values = sorted(v - min(min(values), 0) + 1e-7 for v in values)
        n = len(values)
        return sum((2 * i - n - 1) * v for i, v in enumerate(values, 1)) / (n * sum(values))

    rng = random.Random(2)
    many = [rng.choice([0, 0, 5, rng.randrange(1000)]) for _ in range(700)]
    for values in [[1, 1, 1, 1], [0, 0, 0, 10], [-5, 3, 9], many]:
        got = network_metrics.gini_index(balances(spark, values)).first()
        assert got.gini_index == pytest.approx(plain(values), abs=1e-9)
        assert 0 <= got.gini_index + 1e-12 < 1 and got.n == len(values)
    wealth = network_metrics.wealth(balances(spark, [0, 0, 4, 8])).first()
    assert wealth.average_wealth == 3.0
    assert wealth.gini_index_no_zeros == pytest.approx(plain([4, 8]))


def test_core(spark):
    def plain(degrees):
        order = sorted(degrees, reverse=True)
        z, best, k_best = 0.5 * sum(order), None, -1
        for k, degree in enumerate(order):
            z += k - 1 - degree
            if best is None or z < best:
                best, k_best = z, k
        return k_best, sorted(order[:k_best])

    rng = random.Random(3)
    cases = [[4, 1, 1, 1, 1], [0, 0], [3, 3, 3, 3, 2], [rng.randrange(30) for _ in range(200)]]
    for degrees in cases:
        table = spark.createDataFrame([(i, d) for i, d in enumerate(degrees)], "entity_id bigint, degree bigint")
        k_best, core = plain(degrees)
        assert rows(network_metrics.core_size(table)) == [(k_best, len(degrees))]
        got = [d for d, n in rows(network_metrics.core_description(table)) for _ in range(n)]
        assert got == core


def test_output_spent_at_the_cut_off_still_counts(spark):
    tx, tx_in, tx_out = Book().pay(1, [("A", 7)], block=5).pay(2, [("B", 7)], [(1, 0)], block=9).tables(spark)
    entity = spark.createDataFrame([("A", 1), ("B", 2)], "address string, entity_id bigint")
    lifetimes = network_metrics.output_lifetimes(tx, tx_in, tx_out)
    at = lambda block: dict(rows(network_metrics.entity_balances(entity, lifetimes, block)))
    assert at(4) == {1: 0, 2: 0}
    assert at(9) == {1: 7, 2: 7}
    assert at(10) == {1: 0, 2: 7}


def test_balance_series_equals_single_cut_offs(spark):
    tx, tx_in, tx_out = random_book(12).tables(spark)
    entity = entities.entities(tx_out, tx_in)
    lifetimes = network_metrics.output_lifetimes(tx, tx_in, tx_out)
    cut_offs = [0, 3, 7, 15]
    got = network_metrics.balance_series(lifetimes, entity, cut_offs)
    for cut_off in cut_offs:
        want = rows(network_metrics.entity_balances(entity, lifetimes, cut_off))
        assert rows(got.filter(F.col("cut_off") == cut_off).select("entity_id", "balance")) == want


def test_histogram_map_and_ratios(spark):
    degrees = spark.createDataFrame([(1, 2), (2, 2), (3, 5)], "entity_id bigint, degree bigint")
    hist = network_metrics.histogram(degrees, "degree")
    assert network_metrics.histogram_map(hist).first().distribution == {"2": 2, "5": 1}
    one = lambda text: spark.sql(f"select timestamp '2020-01-01' as snapshot_ts, {text}")
    ratios = network_metrics.series_ratios(
        one("10L as no_ent, 40L as no_addr"), one("2L as core_length"), one("5L as scc_size")
    )
    assert tuple(ratios.first())[1:] == (4.0, 0.2, 50.0)


def test_total_of_balances_is_the_supply(spark):
    tx, tx_in, tx_out = random_book(13).tables(spark)
    entity = entities.entities(tx_out, tx_in)
    lifetimes = network_metrics.output_lifetimes(tx, tx_in, tx_out)
    held = network_metrics.entity_balances(entity, lifetimes, 10_000)
    assert rows(network_metrics.total_of(held, "balance")) == rows(
        network_metrics.total_of(unspent_outputs(tx_out, tx_in), "value")
    )
