"""Embedding whitening on refined principal components.

Entries become whole numbers, so sums and products over the table are exact: every task
adds up integers, and only the finished sums are rounded. The covariance of the table is
thereby known to the last bit of a double, whatever the partitions.

Its eigenvectors come from a float32 solver and are corrected by the iteration of Ogita and
Aishima (2018), which consists of matrix products in a higher precision and doubles the
number of right digits each time. Vectors of eigenvalues that lie too close together for
the correction are only known as a group. They get a sub-solve: the matrix is projected on
the group, which leaves a small matrix with a small spectrum, and its eigenvectors turn the
group. The last iterations run in the longest float type that numpy has.

What reaches the driver is sums and products by dimension, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
# Products of whole numbers are summed as doubles as long as they surely stay exact.
EXACT = 2**53
DIGIT, DIGITS = 40, 4
# x = 1024 * c + 100000 and its distance to a mean are to fit 64 bits.
LARGEST_ENTRY = 2.0**51
BLOCK_ROWS = 4_096
MOST_ROUNDS = 40

WHITENED = pa.schema(
    [
        ("vec_id", pa.int64()),
        ("component", pa.int32()),
        ("n", pa.int64()),
        ("deviation", pa.int64()),
        ("whitened", pa.float64()),
        ("explained", pa.float64()),
        ("identity_error", pa.float64()),
    ]
)


# ---------------------------------------------------------------- rows


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors without null or non-finite entries, as doubles.

    An entry that no 64-bit whole number stands for counts as not finite.
    """
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST_ENTRY))
    return embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")
    ).filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)


def width_of(vectors: DataFrame) -> int:
    """The number of entries that most vectors have (the larger of two as frequent)."""
    found = (
        vectors.groupBy(F.size("vector").alias("width"))
        .count()
        .orderBy(F.col("count").desc(), F.col("width").desc())
        .first()
    )
    return found["width"] if found else 0


def whole_numbers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of floor(1024 * c) + 100000 as 64-bit integers."""
    flat = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(flat * SCALE).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            yield whole_numbers(batch.slice(start, BLOCK_ROWS), width)


# ---------------------------------------------------------------- exact sums


def _largest(table: np.ndarray) -> int:
    return int(np.abs(table).max(initial=0))


class _Exact:
    """A running sum of integer tables, kept as digits of 40 bits once 64 bits won't do.

    Row ``k * rows + i`` of what is handed over holds digit k of row i.
    """

    def __init__(self, rows: int, width: int):
        self.rows = rows
        self.total = np.zeros((rows, width), np.int64)

    def add(self, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        if table.dtype == object:
            for k in range(DIGITS):
                digit = table >> (DIGIT * k)
                if k < DIGITS - 1:
                    digit = digit & ((1 << DIGIT) - 1)
                yield _rows(digit.astype(np.int64), k * self.rows)
            return
        if _largest(self.total) + _largest(table) >= 1 << 62:
            yield self.batch()
            self.total[:] = 0
        self.total += table

    def batch(self) -> pa.RecordBatch:
        return _rows(self.total, 0)


def _rows(table: np.ndarray, first: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "row": pa.array(range(first, first + len(table)), pa.int32()),
            "values": pa.array(list(table), pa.list_(pa.int64())),
        }
    )


def _added(parts: DataFrame, rows: int, width: int) -> list[list[int]]:
    """Tables (row, values) of all tasks, added up entry by entry to whole numbers."""
    entries = parts.select("row", F.posexplode("values").alias("column", "value"))
    summed = (
        entries.groupBy("row", "column")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        .collect()  # one entry per pair of dimensions
    )
    found = [[0] * width for _ in range(rows)]
    for entry in summed:
        k, row = divmod(entry["row"], rows)
        found[row][entry["column"]] += int(entry["value"]) << (DIGIT * k)
    return found


def sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Exact(1, width + 1)
        for block in _blocks(batches, width):
            if _largest(block) * len(block) >= 1 << 62:
                block = block.astype(object)
            yield from kept.add(np.append(block.sum(axis=0), len(block))[None])
        yield kept.batch()

    found = _added(vectors.mapInArrow(each, "row int, values array<long>"), 1, width + 1)[0]
    return found[width], found[:width]


def products(vectors: DataFrame, width: int, centre: list[int]) -> list[list[int]]:
    """Exact sums of (x - centre)(x - centre)' over all rows, in whole numbers."""
    middle = np.array(centre, np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Exact(width, width)
        for block in _blocks(batches, width):
            moved = block - middle
            bound = _largest(moved) ** 2 * len(moved)
            if bound < EXACT:
                doubles = moved.astype(np.float64)
                table = (doubles.T @ doubles).astype(np.int64)
            elif bound < 1 << 62:
                table = moved.T @ moved
            else:
                wide = moved.astype(object)
                table = wide.T @ wide
            yield from kept.add(table)
        yield kept.batch()

    return _added(vectors.mapInArrow(each, "row int, values array<long>"), width, width)


def covariance(n: int, total: list[int], centre: list[int], product: list[list[int]]) -> list[list[int]]:
    """n * n times the covariance (divisor n), as whole numbers.

    Rows were centred on whole numbers next to the means; what is left of the means is
    taken off here without rounding.
    """
    rest = [s - n * c for s, c in zip(total, centre)]
    return [
        [n * value - rest[i] * rest[j] for j, value in enumerate(row)]
        for i, row in enumerate(product)
    ]


# ---------------------------------------------------------------- eigenvectors


def clusters_of(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of sorted neighbours that are no further apart than ``gap``."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def refine(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step in the precision of ``matrix``.

    Returns better vectors, their Rayleigh quotients, the size of the correction and the
    distance below which two eigenvalues count as one cluster. Inside a cluster the step
    only makes the vectors orthonormal.
    """
    size = len(matrix)
    gram = np.eye(size, dtype=matrix.dtype) - vectors.T @ vectors
    projected = vectors.T @ (matrix @ vectors)
    values = np.diagonal(projected) / (1 - np.diagonal(gram))
    off = projected - np.diag(values)
    apart = 2 * (np.linalg.norm(off.astype(np.float64)) + np.abs(values).max(initial=0) * np.linalg.norm(gram.astype(np.float64)))
    # where rounding is all that is left, values closer than it are still one cluster
    apart = max(float(apart), size * float(np.finfo(matrix.dtype).eps) * float(np.abs(values).max(initial=0)))
    difference = values[None, :] - values[:, None]
    near = np.abs(difference) <= apart
    correction = np.where(near, gram / 2, (projected + values[None, :] * gram) / np.where(near, 1, difference))
    return vectors + vectors @ correction, values, correction, apart


def solve_clusters(matrix: np.ndarray, vectors: np.ndarray, values: np.ndarray, gap: float) -> np.ndarray:
    """Turn the vectors of each cluster to the eigenvectors of the matrix projected on it.

    The middle of the cluster is taken off first, so that the small matrix has only what
    tells its eigenvalues apart, which float64 then resolves.
    """
    turned = vectors.copy()
    for part in clusters_of(values.astype(np.float64), gap):
        own = vectors[:, part]
        middle = values[part].mean()
        small = own.T @ (matrix @ own) - middle * (own.T @ own)
        _, turn = np.linalg.eigh(((small + small.T) / 2).astype(np.float64))
        turned[:, part] = own @ turn.astype(matrix.dtype)
    return turned


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit eigenvectors (columns), to double precision.

    ``matrix`` is symmetric, in the precision that its entries are known in. Eigenvalues
    that even this precision doesn't tell apart span a space whose vectors are any
    orthonormal basis.
    """
    size = len(matrix)
    scale = float(np.abs(matrix).max(initial=0)) or 1.0
    matrix = matrix / scale
    _, start = np.linalg.eigh(matrix.astype(np.float32))
    vectors = start.astype(np.float64)
    for kind in (np.float64, matrix.dtype.type):
        exact = matrix.astype(kind)
        vectors = vectors.astype(kind)
        enough = 8 * size * float(np.finfo(kind).eps)
        last = np.inf
        for _ in range(MOST_ROUNDS):
            vectors, values, correction, apart = refine(exact, vectors)
            moved = float(np.abs(correction).max(initial=0))
            if clusters_of(values.astype(np.float64), apart):
                vectors = solve_clusters(exact, vectors, values, apart)
            if moved <= enough or (moved < 1e-6 and moved >= last):
                break
            last = moved
        vectors, *_ = refine(exact, vectors)
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    values = ((matrix @ vectors) * vectors).sum(axis=0) * scale
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# ---------------------------------------------------------------- whitening


def _scaled(numerators: list[list[int]], divisor: int) -> np.ndarray:
    """Whole numbers over a whole number, rounded once to the longest float type."""
    # the quotient's whole part and the rest are each rounded on their own
    found = np.zeros((len(numerators), len(numerators)), np.longdouble)
    for i, row in enumerate(numerators):
        for j, value in enumerate(row):
            whole, rest = divmod(value, divisor)
            high, low = divmod(whole, 1 << 32)
            found[i, j] = (
                np.longdouble(high) * np.longdouble(1 << 32) + np.longdouble(low) + np.longdouble(rest / divisor)
            )
    return found


class Whitening:
    """A fitted map from vectors to their whitened leading components."""

    def __init__(self, n: int, total: list[int], numerators: list[list[int]], components: int):
        self.n = n
        self.total = np.array(total, dtype=object)
        self.width = len(total)
        values, vectors = eigenvectors(_scaled(numerators, n * n))
        trace = float(sum(row[i] for i, row in enumerate(numerators)) / (n * n))
        self.values = values[:components].astype(np.float64)
        self.vectors = vectors[:, :components].astype(np.float64)
        self.explained = self.values / trace if trace else np.zeros(len(self.values))
        # variance that is only rounding has no direction
        self.real = self.values > 1e-12 * max(float(values.max(initial=0)), 1e-300)
        self.factors = np.where(self.real, 1 / np.sqrt(np.where(self.real, self.values, 1)), 0)
        self._wide = max((abs(s) for s in total), default=0) >= 2**61

    def differences(self, block: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as 64-bit integers if they surely fit."""
        if self._wide or _largest(block) * self.n >= 2**61:
            return block.astype(object) * self.n - self.total
        return block * self.n - self.total.astype(np.int64)

    def apply(self, moved: np.ndarray) -> np.ndarray:
        return ((moved / self.n).astype(np.float64) @ self.vectors) * self.factors


def deviations(moved: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; null where one is beyond 64 bits."""
    if moved.dtype != object and _largest(moved) ** 2 * moved.shape[1] < 2**62:
        return (moved * moved).sum(axis=1).tolist()
    wide = moved.astype(object)
    found = (wide * wide).sum(axis=1).tolist()
    return [value if value < 2**63 else None for value in found]


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of ``vectors``, each with ``width`` entries."""
    n, total = sums(vectors, width)
    if not n:
        return None
    centre = [(2 * s + n) // (2 * n) for s in total]
    return Whitening(n, total, covariance(n, total, centre, products(vectors, width, centre)), components)


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity.

    Over the components that have variance. The mean of the whitened rows is taken off as
    well, though it is nothing but rounding.
    """
    size = int(fitted.real.sum())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for block in _blocks(batches, fitted.width):
            own = fitted.apply(fitted.differences(block))[:, fitted.real]
            total += np.vstack([own.T @ own, own.sum(axis=0)])
        yield pa.RecordBatch.from_pydict(
            {"row": pa.array(range(size + 1), pa.int32()), "values": pa.array(list(total), pa.list_(pa.float64()))}
        )

    parts = vectors.mapInArrow(each, "row int, values array<double>")
    entries = parts.select("row", F.posexplode("values").alias("column", "value"))
    found = np.zeros((size + 1, size))
    for entry in entries.groupBy("row", "column").agg(F.sum("value").alias("value")).collect():
        found[entry["row"], entry["column"]] = entry["value"] / fitted.n
    square = found[:size] - np.outer(found[size], found[size])
    return float(np.abs(square - np.eye(size)).max(initial=0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error).

    One row for each remaining row of ``embeddings`` and each of its leading components.
    Rows with a null vector or a null or non-finite entry (or one of 2**51 or more, as its x
    is no long) are dropped, and so are vectors without entries. A table has one width, the one of most vectors (the larger of two as
    frequent); vectors of another width have no place in its covariance and are dropped.
    Repeated rows and ids count and are returned as often as they come, null ids too.
    Components without variance, as in a table of equal rows, are 0 everywhere. A
    deviation beyond 64 bits is null. An empty table gives no rows; other columns are
    not read.
    """
    every = usable(embeddings)
    width = width_of(every)
    vectors = every.filter(F.size("vector") == width)
    fitted = fit(vectors, width, components) if width else None
    if fitted is None:
        return embeddings.sparkSession.createDataFrame(
            [],
            "vec_id long, component int, n long, deviation long, whitened double, "
            "explained double, identity_error double",
        )
    error = identity_error(vectors, fitted)
    count = len(fitted.values)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                moved = fitted.differences(whole_numbers(part, fitted.width))
                rows = np.repeat(np.arange(len(moved)), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["vec_id"].take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(moved))),
                        pa.array(np.full(len(rows), fitted.n)),
                        pa.array(deviations(moved), pa.int64()).take(pa.array(rows)),
                        pa.array(fitted.apply(moved).reshape(-1)),
                        pa.array(np.tile(fitted.explained, len(moved))),
                        pa.array(np.full(len(rows), error)),
                    ],
                    schema=WHITENED,
                )

    return vectors.mapInArrow(
        each,
        "vec_id long, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double",
    )
