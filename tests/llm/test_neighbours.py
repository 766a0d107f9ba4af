"""Nearest neighbours against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from utxolens.llm import neighbours


def exact(ids, vectors, query, count):
    scores = (vectors * vectors[query]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if i != query][:count]
    return [(int(ids[i]), float(scores[i])) for i in order]


def run(spark, ids, vectors, **settings):
    df = spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>"
    ).repartition(3)
    found = defaultdict(list)
    for row in sorted(neighbours.nearest(df, **settings).collect(), key=lambda r: (r.query_id, r.rank)):
        found[row.query_id].append((row.vec_id, row.score))
        assert row.rank == len(found[row.query_id])
    return found


@pytest.mark.parametrize("lengths", [False, True])
def test_recall_and_scores(spark, monkeypatch, lengths):
    monkeypatch.setattr(neighbours, "LEAST_CANDIDATES", 10)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(4000, 16)) + 2 * rng.normal(size=(12, 16))[rng.integers(0, 12, 4000)]
    if lengths:
        vectors *= rng.uniform(0.5, 2, (4000, 1))
    vectors = vectors.astype(np.float32).astype(np.float64)
    ids = rng.permutation(10_000)[:4000]
    found = run(spark, ids, vectors)
    place, hits, total = {int(k): i for i, k in enumerate(ids)}, 0, 0
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    for query, got in found.items():
        want = exact(ids, vectors, place[query], 20)
        hits += len({i for i, _ in got} & {i for i, _ in want})
        total += len(want)
        own = vectors[place[query]]
        assert all(abs(score - (vectors[place[i]] * own).sum()) < 1e-9 for i, score in got)
    assert hits >= 0.9 * total


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", 50 * 8 * 8)
    rng = np.random.default_rng(2)
    vectors = np.ones((900, 8))
    vectors[:300] = rng.normal(size=(300, 8)) / 9
    ids = rng.permutation(900)
    found = run(spark, ids, vectors)
    twins = sorted(int(i) for i, v in zip(ids, vectors) if (v == 1).all())
    query = next(i for i in twins if i % 20 == 0)
    assert [i for i, _ in found[query]] == [i for i in twins if i != query][:20]


def test_few_and_unusable_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.9, 0.1]), (3, [0.9, 0.1]), (40, None), (60, [0.0, 0.0]),
        (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (160, []),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 as list", "2 as score", "3 as row", "4 as block"
    )
    got = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(df).collect())
    assert got == [(0, 1, 3), (0, 2, 3), (0, 3, 20), (20, 1, 0), (20, 2, 3), (20, 3, 3)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_rows_that_share_an_id_and_vectors_of_other_lengths(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (7, [3.0, 1.0]), (9, [0.25]), (11, [1.0, 1.0, 8.0]), (60, [0.5, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df).collect())
    assert got == sorted([
        (20, 1, 7, 3.0), (20, 2, 11, 1.0), (20, 3, 60, 0.5), (20, 4, 9, 0.25), (20, 5, 20, 0.0),
        (20, 1, 7, 2.0), (20, 2, 11, 2.0), (20, 3, 9, 0.0), (20, 4, 20, 0.0), (20, 5, 60, 0.0),
        (60, 1, 11, 16.5), (60, 2, 7, 1.5), (60, 3, 20, 0.5), (60, 4, 9, 0.125), (60, 5, 20, 0.0),
    ])


def test_clustered_vectors_are_found_in_few_lists(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(20_000, 24)) + 4 * rng.normal(size=(150, 24))[rng.integers(0, 150, 20_000)]
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    vectors = vectors.astype(np.float32).astype(np.float64)
    ids = np.arange(20_000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    figures = neighbours.search_lists(df).figures()
    assert figures["scored"] <= 0.1 and figures["copies"] <= 1.5, figures
    found = run(spark, ids, vectors)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in exact(ids, vectors, q, 20)}) for q in range(0, 20_000, 20))
    assert hits >= 0.9 * 20 * 1000


def test_the_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    graph = neighbours.CentroidGraph.over(rng.normal(size=(200, 12)))
    hits = 0
    for vector in rng.normal(size=(100, 12)):
        distances = ((graph.centroids - vector) ** 2).sum(axis=1)
        want = set(np.argsort(distances)[:8].tolist())
        hits += len(want & {c for _, c in graph.search(vector, 16)[:8]})
    assert hits >= 0.95 * 800


def test_lists_have_like_sizes():
    rng = np.random.default_rng(6)
    sample = np.vstack([rng.normal(size=(1500, 8)) * 0.1, rng.normal(size=(500, 8)) + 3])
    centroids = neighbours.balanced_centroids(sample, 20)
    level = np.column_stack([sample, np.zeros(len(sample))])
    owner = ((level[:, None, :] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.bincount(owner, minlength=20).max() <= 5 * len(sample) / 20
