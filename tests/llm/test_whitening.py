"""Whitening against exact arithmetic and known spectra."""

from fractions import Fraction

import numpy as np
import pytest

from utxolens.llm import queries, whitening


def vectors_table(spark, ids, vectors, parts=3):
    rows = [(int(i), [float(c) for c in v], "x", 1) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, component string, n int"
    ).repartition(parts)


def fractions_of(vectors):
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    total = [sum(row[d] for row in x) for d in range(width)]
    moved = [[n * c - s for c, s in zip(row, total)] for row in x]
    cov = [
        [Fraction(sum(row[i] * row[j] for row in moved), n**3) for j in range(width)] for i in range(width)
    ]
    return moved, cov


def check(spark, vectors, components=8):
    """Rows of whiten() against the contract, with the covariance in exact fractions."""
    ids = np.random.default_rng(1).permutation(len(vectors))
    found = whitening.whiten(vectors_table(spark, ids, vectors), components).collect()
    moved, cov = fractions_of(vectors)
    n, width = len(vectors), len(vectors[0])
    count = min(components, width)
    assert len(found) == n * count
    place = {int(i): k for k, i in enumerate(ids)}
    got = np.zeros((n, count))
    explained = np.zeros(count)
    for row in found:
        k = place[row.vec_id]
        assert row.n == n and row.deviation == sum(c * c for c in moved[k])
        got[k, row.component - 1] = row.whitened
        explained[row.component - 1] = row.explained
        assert row.identity_error <= 1e-9
    values = np.linalg.eigvalsh(np.array(cov, dtype=float))[::-1]
    trace = float(sum(cov[d][d] for d in range(width)))
    assert np.allclose(explained, values[:count] / trace, rtol=1e-9, atol=1e-12)
    real = values[:count] > 1e-9 * values[0]
    assert np.allclose((got.T @ got / n)[real][:, real], np.eye(int(real.sum())), atol=1e-9)
    return got, np.array(moved, dtype=float) / n, values


def test_against_exact_covariance(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 0.1
    got, centred, values = check(spark, vectors)
    # whitened rows are the projections on eigenvectors: V (Y'w) = e (Y'w)
    cov = centred.T @ centred / len(centred)
    for c in range(8):
        direction = centred.T @ got[:, c]
        assert np.allclose(cov @ direction, values[c] * direction, rtol=1e-8, atol=1e-8 * abs(direction).max())


def test_clustered_eigenvalues_are_resolved():
    rng = np.random.default_rng(5)
    size = 40
    basis, _ = np.linalg.qr(rng.normal(size=(size, size)))
    values = np.sort(np.concatenate([1 + 1e-9 * np.arange(10), [2, 2 + 1e-12], rng.uniform(3, 9, size - 12)]))[::-1]
    matrix = (basis.astype(np.longdouble) * values.astype(np.longdouble)) @ basis.T.astype(np.longdouble)
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.eigenvectors(matrix)
    assert vectors.dtype == np.longdouble
    assert float(abs(vectors.T @ vectors - np.eye(size)).max()) < 1e-16
    rest = matrix @ vectors - vectors * found
    assert float(abs(rest).max()) < 1e-15
    # gaps of 1e-9, invisible to float32, come out as vectors of their own
    plain, start = np.linalg.eigh(matrix.astype(np.float32))
    assert float(abs(matrix @ start.astype(np.longdouble) - start * plain).max()) > 1e-8


def test_equal_and_zero_eigenvalues():
    for matrix in (np.eye(6), np.zeros((5, 5)), np.diag([3.0, 3, 1, 1, 0, 0]), np.ones((4, 4)), np.array([[2.5]])):
        values, vectors = whitening.eigenvectors(matrix.astype(np.longdouble))
        assert np.isfinite(vectors.astype(float)).all() and np.isfinite(values.astype(float)).all()
        assert float(abs(vectors.T @ vectors - np.eye(len(matrix))).max()) < 1e-15
        assert float(abs(matrix @ vectors - vectors * values).max()) < 1e-15
        assert (np.diff(values.astype(float)) <= 1e-15).all()


@pytest.mark.parametrize("scale", [1.0, 3e5, 4e9])
def test_sums_of_any_size_are_exact(spark, scale):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 3)) * scale
    df = whitening.usable(vectors_table(spark, range(60), vectors))
    moved, cov = fractions_of(vectors)
    n, total = whitening.sums(df, 3)
    centre = [(2 * s + n) // (2 * n) for s in total]
    numerators = whitening.covariance(n, total, centre, whitening.products(df, 3, centre))
    assert n == 60 and [[Fraction(v, n * n) for v in row] for row in numerators] == cov
    fitted = whitening.fit(df, 3)
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors])
    assert fitted.differences(x).tolist() == moved
    exact = [sum(c * c for c in row) for row in moved]
    assert whitening.deviations(fitted.differences(x)) == [v if v < 2**63 else None for v in exact]


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0, 2.0]), (2, [0.5, 0.5, 1.0]), (2, [0.5, 0.5, 1.0]), (None, [0.9, 0.1, -3.0]), (4, None),
        (5, [1.0, None, 1.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, []), (9, [1.0, 2.0]),
        (10, [1e300, 0.0, 0.0]), (11, [0.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'a' as whitened", "1 as n")
    found = whitening.whiten(df).collect()
    ids = sorted(str(r.vec_id) for r in found)
    assert ids == sorted(["1"] * 3 + ["2"] * 6 + ["None"] * 3 + ["11"] * 3)
    assert {r.n for r in found} == {5} and {r.component for r in found} == {1, 2, 3}
    twins = {(r.component, r.whitened, r.deviation) for r in found if r.vec_id == 2}
    assert len(twins) == 3
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id in (4, 8)")).count() == 0
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    found = whitening.whiten(alike).collect()
    assert len(found) == 8 and all(r.whitened == 0 and r.deviation == 0 and r.identity_error == 0 for r in found)
    assert all(r.explained == 0 for r in found)


def test_the_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    found = queries.op12_whitening(spark, folder).toPandas()
    source = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    vectors = np.vstack([np.asarray(v, np.float64) for v in source["embedding"]])
    moved, cov = fractions_of(vectors.tolist())
    assert len(found) == 8 * len(vectors) and (found["identity_error"] <= 1e-4).all()
    deviation = dict(zip(source["vec_id"], (sum(c * c for c in row) for row in moved)))
    assert (found["deviation"] == found["vec_id"].map(deviation)).all()
    values, directions = np.linalg.eigh(np.array(cov, dtype=float))
    centred = np.array(moved, dtype=float) / len(vectors)
    for c in range(1, 9):
        own = found[found["component"] == c].set_index("vec_id")["whitened"].loc[source["vec_id"]].to_numpy()
        want = centred @ directions[:, -c] / np.sqrt(values[-c])
        assert min(abs(own - want).max(), abs(own + want).max()) < 1e-8
