from pyspark.sql import functions as F

from ledgers import Book, random_book, rows
from utxolens.operators import edges, graph_queries, utxo


def book():
    return (
        Book()
        .pay(1, [("A", 5_000_000), ("B", 7_000_000)])
        .pay(2, [("C", 4_000_000), ("A", 1_000_000)], [(1, 0)])
        .pay(3, [("D", 8_000_000)], [(1, 1), (2, 1)])
    )


def test_transaction_network(spark):
    assert rows(utxo.transaction_network(*book().tables(spark))) == [
        ("h2", "A", "C", 5.0, 4.0),
        ("h3", "A", "D", 1.0, 8.0),
        ("h3", "B", "D", 7.0, 8.0),
    ]


def test_equal_outputs_of_one_address_are_one_row(spark):
    tables = Book().pay(1, [("A", 5), ("A", 5)]).pay(2, [("B", 9)], [(1, 0), (1, 1)]).tables(spark)
    assert len(rows(utxo.tx_inputs(*tables))) == 1
    assert len(rows(utxo.transaction_network(*tables))) == 1
    assert len(rows(utxo.network_pairs(*tables))) == 2


def test_pairs_with_equal_ends_and_without_outputs(spark):
    tx, tx_in, tx_out = book().tables(spark)
    every = utxo.network_pairs(tx, tx_in, tx_out, different_ends=False)
    assert ("A", "A", "h2", 5.0) in rows(every)
    no_outputs = utxo.network_pairs(tx, tx_in, tx_out.filter("tx_id <> 3"), different_ends=False)
    assert [r.output for r in no_outputs.filter("tx_hash = 'h3'").collect()] == [None, None]


def test_unspent_and_supply(spark):
    tx, tx_in, tx_out = book().tables(spark)
    assert rows(utxo.unspent_outputs(tx_out, tx_in).select("address")) == [("C",), ("D",)]
    assert rows(utxo.current_supply(tx_out, tx_in)) == [(12.0,)]


def test_received_minus_spent_is_unspent_per_address(spark):
    _, tx_in, tx_out = random_book(3).tables(spark)
    total = lambda df, name: df.groupBy("address").agg(F.sum("value").alias(name))
    received = total(tx_out, "received")
    spent = total(utxo.spent_outputs(tx_out, tx_in), "spent")
    left = total(utxo.unspent_outputs(tx_out, tx_in), "unspent")
    joined = received.join(spent, "address", "left").join(left, "address", "left").na.fill(0)
    assert joined.filter("received - spent <> unspent").count() == 0


def test_address_ids_are_dense_and_continue(spark):
    _, _, tx_out = random_book(4).tables(spark)
    first = utxo.address_ids(tx_out.filter("tx_id <= 20"))
    count = first.count()
    assert sorted(r.id for r in first.collect()) == list(range(1, count + 1))
    fresh = utxo.new_addresses(tx_out, first)
    later = utxo.address_ids(fresh, last_id=count)
    assert sorted(r.id for r in later.collect()) == list(range(count + 1, count + 1 + fresh.count()))


def test_network_with_unknown_address_has_null_id(spark):
    tx, tx_in, tx_out = book().tables(spark)
    ids = spark.createDataFrame([(1, "A")], "id bigint, address string")
    found = utxo.network_with_ids(utxo.transaction_network(tx, tx_in, tx_out), tx, ids)
    assert {(r.input_addr_id, r.output_addr_id) for r in found.collect()} == {(1, None), (None, None)}


def test_range_is_inclusive(spark):
    tables = book().tables(spark)
    assert {r.tx_id for r in utxo.network_slice(*tables, 2, 3).collect()} == {2, 3}
    assert {r.tx_id for r in utxo.network_slice(*tables, 3, 9).collect()} == {3}


def test_co_inputs(spark):
    _, tx_in, tx_out = book().tables(spark)
    assert rows(utxo.co_input_pairs(tx_out, tx_in)) == [(3, "A", "B"), (3, "B", "A")]
    assert rows(utxo.co_input_pairs(tx_out, tx_in, both_orders=False)) == [(3, "A", "B")]
    assert rows(utxo.co_input_links(tx_out, tx_in)) == [(3, "A", "B")]


def test_degrees_equal_those_of_the_edges(spark):
    tables = random_book(5).tables(spark)
    network = utxo.transaction_network(*tables).collect()
    want = {}
    for row in network:
        want.setdefault(row.input_addr, [0, 0])[0] += 1
        want.setdefault(row.output_addr, [0, 0])[1] += 1
    got = {
        r.address: [r.out_degree, r.in_degree]
        for r in graph_queries.address_degrees(*tables).filter("degree > 0").collect()
    }
    assert got == want


def test_script_network_and_hash(spark):
    tx, tx_in, tx_out = book().tables(spark)
    script = spark.createDataFrame(
        [("s1", 2, "plutus"), ("s2", 3, "timelock")], "hash string, tx_id bigint, type string"
    )
    of = lambda kind: {
        r.tx_hash for r in graph_queries.script_network(tx, tx_in, tx_out, script, kind).collect()
    }
    assert (of(None), of("plutus"), of("timelock")) == ({"h2", "h3"}, {"h2"}, {"h3"})
    assert rows(graph_queries.tx_by_hash(tx, tx_in, tx_out, "h2")) == [("A", 5.0, "C", 4.0)]


def test_neighbour_sets_are_split_but_whole(spark):
    pairs = spark.range(1000).selectExpr("'hub' as src", "cast(id as string) as dst")
    pairs = pairs.unionByName(spark.createDataFrame([("x", "y")], "src string, dst string"))
    sets = edges.neighbour_sets(pairs, "src", "dst", max_size=100).collect()
    hub = [r for r in sets if r.src == "hub"]
    assert len(hub) > 10 and max(r.size for r in hub) <= 100
    members = [m for r in hub for m in r.neighbours]
    assert len(members) == 1000 and len(set(members)) == 1000


def test_weighted_edges_and_relationship_count(spark):
    pairs = utxo.network_pairs(*book().tables(spark))
    assert ("A", "C", 5.0) in rows(graph_queries.weighted_edges(pairs))
    toy = spark.createDataFrame([("a", "b", "follow"), ("b", "c", "friend")], "src string, dst string, relationship string")
    assert rows(graph_queries.edge_relationship_count(toy, "follow")) == [(1,)]
