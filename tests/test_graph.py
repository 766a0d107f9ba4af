import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgers import rows, union_find
from utxolens.operators import graph_algorithms as algorithms
from utxolens.operators import graph_queries

TOY = [("a", "b"), ("b", "c"), ("c", "b"), ("f", "c"), ("e", "f"), ("e", "d"), ("d", "a"), ("a", "e")]


def edge_table(spark, pairs, kind="string"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def random_edges(seed, nodes, count):
    rng = random.Random(seed)
    return sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)})


def strong_components(pairs):
    """By mutual reachability, on a graph small enough for that."""
    out = defaultdict(set)
    nodes = {n for pair in pairs for n in pair}
    for a, b in pairs:
        out[a].add(b)

    def reach(start):
        seen, todo = {start}, [start]
        while todo:
            for other in out[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        return seen

    reached = {n: reach(n) for n in nodes}
    return {n: min(m for m in reached[n] if n in reached[m]) for n in nodes}


def page_rank(pairs, rounds, source=None):
    nodes = sorted({n for pair in pairs for n in pair})
    out = defaultdict(int)
    for a, _ in pairs:
        out[a] += 1
    start = {n: 1.0 if source in (None, n) else 0.0 for n in nodes}
    rank = dict(start)
    for _ in range(rounds):
        following = {n: 0.15 * start[n] for n in nodes}
        for a, b in pairs:
            following[b] += 0.85 * rank[a] / out[a]
        rank = following
    total = len(nodes) if source is None else 1
    mass = sum(rank.values())
    return {n: r * total / mass for n, r in rank.items()}


@pytest.mark.parametrize("seed, nodes, count", [(2, 200, 150), (3, 30, 200)])
def test_components(spark, seed, nodes, count):
    pairs = random_edges(seed, nodes, count)
    got = dict(rows(algorithms.connected_components(edge_table(spark, pairs, "bigint"))))
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == union_find([p for p in pairs if p[0] != p[1]], linked)


def test_components_of_a_long_chain_and_of_nothing(spark):
    order = list(range(300))
    random.Random(7).shuffle(order)
    chain = edge_table(spark, list(zip(order, order[1:])), "bigint")
    assert {c for _, c in rows(algorithms.connected_components(chain))} == {0}
    assert rows(algorithms.connected_components(chain.limit(0))) == []
    assert rows(algorithms.connected_components(chain.filter("src < 0"))) == []


def test_components_do_not_depend_on_partitions(spark):
    pairs = edge_table(spark, random_edges(5, 80, 90), "bigint")
    one = rows(algorithms.connected_components(pairs.repartition(1)))
    assert one == rows(algorithms.connected_components(pairs.repartition(7)))


@pytest.mark.parametrize("seed, nodes, count", [(2, 60, 110)])
def test_strong_components(spark, seed, nodes, count):
    pairs = random_edges(seed, nodes, count)
    table = edge_table(spark, pairs, "bigint")
    want = strong_components(pairs)
    assert dict(rows(algorithms.strongly_connected_components(table))) == want
    largest = max(list(want.values()).count(c) for c in want.values())
    assert rows(algorithms.largest_scc(table)) == [(largest,)]


def test_strong_components_by_hand(spark):
    table = edge_table(spark, [(1, 2), (2, 3), (3, 1), (3, 4)], "bigint")
    assert rows(algorithms.largest_scc(table)) == [(3,)]
    chain = edge_table(spark, [(i, i + 1) for i in range(50)], "bigint")
    assert rows(algorithms.largest_scc(chain)) == [(1,)]
    assert rows(algorithms.largest_scc(chain.filter("src < 0"))) == [(0,)]


def test_only_changed_labels_are_told_to_neighbours(spark, monkeypatch):
    """A ring with chords: after some rounds few vertices have news, and the last has none."""
    told = []
    write = algorithms.WorkTables.write

    def kept(self, df, label):
        table = write(self, df, label)
        if label == "labels":
            told.append(table.filter("ahead_moved or behind_moved").count())
        return table

    monkeypatch.setattr(algorithms.WorkTables, "write", kept)
    size = 200
    ring = [(n, (n + 1) % size) for n in range(size)] + [(n, (n * 7 + 3) % size) for n in range(0, size, 2)]
    table = edge_table(spark, sorted(set(ring)), "bigint")
    assert set(rows(algorithms.strongly_connected_components(table))) == {(n, 0) for n in range(size)}
    assert told[0] == size and told[-1] == 0 and sum(told) < size * (len(told) - 1)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_page_rank(spark):
    table = edge_table(spark, TOY)
    for got, want in [
        (algorithms.pagerank(table, max_iter=10), page_rank(TOY, 10)),
        (algorithms.pagerank(table, max_iter=7, source="a"), page_rank(TOY, 7, "a")),
    ]:
        assert dict(rows(got)) == pytest.approx(want, abs=1e-9)


def test_page_rank_to_a_tolerance(spark):
    got = dict(rows(algorithms.pagerank(edge_table(spark, TOY), tol=1e-6)))
    assert got == pytest.approx(page_rank(TOY, 200), abs=1e-4)
    assert sum(got.values()) == pytest.approx(6)


def test_parallel_page_rank(spark):
    got = algorithms.parallel_personalized_pagerank(edge_table(spark, TOY), ["a", "e"], 6)
    found = {(r.source_id, r.id): r.pagerank for r in got.collect()}
    for source in "ae":
        want = {n: r for n, r in page_rank(TOY, 6, source).items() if r > 0}
        assert {n: r for (s, n), r in found.items() if s == source} == pytest.approx(want)


def test_edge_weights(spark):
    weights = {(r.src, r.dst): r.weight for r in algorithms.edge_weights(edge_table(spark, TOY)).collect()}
    assert weights[("a", "b")] == 0.5 and weights[("f", "c")] == 1.0


def test_rounds_of_page_rank_move_sources_instead_of_edges(spark, monkeypatch):
    """No table of the rounds has a row per edge, and a hot source comes in bounded lists."""
    written = []
    write = algorithms.WorkTables.write

    def counted(self, df, label):
        table = write(self, df, label)
        written.append(table.count())
        return table

    monkeypatch.setattr(algorithms.WorkTables, "write", counted)
    pairs = random_edges(9, 40, 500)
    got = dict(rows(algorithms.pagerank(edge_table(spark, pairs, "bigint"), tol=1e-6)))
    assert got == pytest.approx(page_rank(pairs, 100), abs=1e-4)
    assert max(written) <= 40 < len(pairs)

    hot = [(0, n) for n in range(1, 101)] + [(1, 2)]
    lists = algorithms.target_lists(edge_table(spark, hot, "bigint"), size=20).collect()
    assert sorted((r.id, n) for r in lists for n in r.targets) == hot
    assert max(len(r.targets) for r in lists) <= 20
    assert {(r.id, r.weight) for r in lists} == {(0, 0.01), (1, 1.0)}


def test_page_rank_holds_the_ranks_of_one_round(spark, monkeypatch):
    """Each round is a table of its own, so that its shuffles go, and the one before goes too."""
    held, most = set(), []
    write, drop = algorithms.WorkTables.write, algorithms.WorkTables.drop

    def kept(self, df, label):
        table = write(self, df, label)
        if label == "ranks":
            held.add(self.path(table))
            most.append(len(held))
        return table

    def dropped(self, table):
        held.discard(self.path(table))
        drop(self, table)

    monkeypatch.setattr(algorithms.WorkTables, "write", kept)
    monkeypatch.setattr(algorithms.WorkTables, "drop", dropped)
    pairs = random_edges(9, 40, 200)
    table = edge_table(spark, pairs, "bigint")
    got = dict(rows(algorithms.pagerank(table, max_iter=6)))
    assert got == pytest.approx(page_rank(pairs, 6), abs=1e-9)
    assert len(most) == 7 and max(most) == 2 and len(held) == 1
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_triangles(spark):
    pairs = random_edges(8, 25, 110)
    links = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    want = {n: 0 for link in links for n in link}
    for a, b in links:
        for c in want:
            if c > b and (a, c) in links and (b, c) in links:
                for n in (a, b, c):
                    want[n] += 1
    assert dict(rows(algorithms.triangle_count(edge_table(spark, pairs, "bigint")))) == want


def test_motif_in_degrees_and_adjacency(spark):
    table = edge_table(spark, TOY)
    assert rows(graph_queries.motif_mutual(table)) == [("b", "c"), ("c", "b")]
    assert dict(rows(graph_queries.in_degrees(table))) == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 1, "f": 1}
    assert dict(rows(graph_queries.adjacency_sizes(table)))["e"] == 3


def test_rounds_of_components_move_fewer_and_fewer_links(spark, monkeypatch):
    """All rounds together write a few times the links, on long paths too."""
    written = []
    write = algorithms.WorkTables.write

    def counted(self, df, label):
        table = write(self, df, label)
        if label == "links":
            written.append(table.count())
        return table

    monkeypatch.setattr(algorithms.WorkTables, "write", counted)
    chain = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {c for _, c in rows(algorithms.connected_components(chain))} == {0}
    assert sum(written) <= 3 * 3000
