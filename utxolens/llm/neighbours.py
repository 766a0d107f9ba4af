"""Approximate nearest neighbours by inner product, over balanced posting lists.

Centroids are fitted on a bounded sample so that lists have like sizes; every vector is
put into its nearest list and, near a boundary, into others that lie in other directions.
A small graph over the centroids leads a vector or a query to its lists. A query takes the
lists whose distance is within a ratio of the nearest one's. The ratio is measured on the
sample: it is the one that leads to nearly all of the sample's own neighbours, so clustered
vectors are found in few lists and vectors without clusters in many. Candidates get exact
scores.

Inner product becomes distance by one more component that gives all vectors the same
length, and queries none of it. Rows are told apart by a number of their own, since a
vec_id may stand in several.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utxolens.sources.storage import WorkTables

NEIGHBOURS = 20
QUERY_STEP = 20
SAMPLE_ROWS = 40_000  # about so many vectors, at most, fit the centroids and the ratio
SAMPLE_BYTES = 64 << 20
LIST_ROWS = 256  # vectors for each centroid
MOST_LISTS = 4_096  # longer lists beyond a million vectors
SAMPLE_PER_LIST = 8
ROUNDS = 12
DEGREE = 16
REPLICAS = 4
REPLICA_RATIO = 1.08
PLACE_WIDTH = 64  # centroids held while a vector's lists are sought
TARGET = 0.95  # share of the sample's neighbours that the ratio leads to
TRIALS = 400  # vectors of the sample asked for that
QUERY_PARTS = 16  # a chunk of queries is so much smaller than one of vectors
LEAST_CANDIDATES = 10  # for each neighbour asked for, whatever the ratio says
CHUNK_BYTES = 8 << 20  # of vectors that meet queries in one group
BLOCK = 1 << 22  # distances held at a time on the driver


def _blocks(rows: int, width: int) -> list[slice]:
    step = max(1, BLOCK // max(1, width))
    return [slice(start, start + step) for start in range(0, rows, step)]


@dataclass
class Reach:
    """How far a query looks: a ratio of the distance of its nearest list.

    A list of mere copies is nearer than any other by a factor that says nothing of the
    rest, so no list counts as nearer than the nearest usually is.
    """

    ratio: float
    usual: float


@dataclass
class CentroidGraph:
    """Centroids with links to the nearest others, and one to the next in line."""

    centroids: np.ndarray
    links: np.ndarray

    @classmethod
    def over(cls, centroids: np.ndarray) -> "CentroidGraph":
        count = len(centroids)
        degree = min(DEGREE, max(1, count - 1))
        norms, nearest = (centroids**2).sum(axis=1), np.zeros((count, degree), int)
        for part in _blocks(count, count):
            distances = norms - 2 * centroids[part] @ centroids.T
            rows = np.arange(len(distances))
            distances[rows, rows + part.start] = np.inf
            closest = np.argpartition(distances, degree - 1, axis=1)[:, :degree]
            order = np.argsort(distances[rows[:, None], closest], axis=1, kind="stable")
            nearest[part] = closest[rows[:, None], order]
        ring = (np.arange(count) + 1) % count  # no part is out of reach
        return cls(centroids, np.column_stack([nearest, ring]))

    def search(self, vector: np.ndarray, width: int) -> list[tuple[float, int]]:
        """About the ``width`` nearest centroids as (distance, centroid), nearest first."""
        seen = np.zeros(len(self.centroids), bool)
        starts = np.unique(np.linspace(0, len(self.centroids) - 1, 8).astype(int))
        seen[starts] = True
        first = np.sqrt(((self.centroids[starts] - vector) ** 2).sum(axis=1))
        open_ = list(zip(first.tolist(), starts.tolist()))
        heapq.heapify(open_)
        best = [(-d, c) for d, c in open_]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while open_:
            distance, node = heapq.heappop(open_)
            if len(best) >= width and distance > -best[0][0]:
                break
            fresh = self.links[node]
            fresh = np.unique(fresh[~seen[fresh]])
            if not len(fresh):
                continue
            seen[fresh] = True
            reached = np.sqrt(((self.centroids[fresh] - vector) ** 2).sum(axis=1))
            for d, c in zip(reached.tolist(), fresh.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-d, c))
                    heapq.heappush(open_, (d, c))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, c))
                    heapq.heappush(open_, (d, c))
        return sorted((-d, c) for d, c in best)

    def lists_of(self, vector: np.ndarray) -> list[int]:
        """The nearest list, and others across a near boundary.

        A list is across a near boundary if its centroid is about as near, and nearer to
        the vector than to each centroid already taken: lists side by side in the same
        direction would be probed by the same queries.
        """
        found = self.search(vector, PLACE_WIDTH)
        taken = [found[0][1]]
        for distance, c in found[1:]:
            if distance > REPLICA_RATIO * found[0][0] or len(taken) == REPLICAS:
                break
            apart = ((self.centroids[taken] - self.centroids[c]) ** 2).sum(axis=1)
            if (apart > distance**2).all():
                taken.append(c)
        return taken

    def probes(
        self, vector: np.ndarray, sizes: np.ndarray, least: int, reach: Reach
    ) -> list[int]:
        """Lists within the ratio of the nearest; more while they hold too few vectors.

        The search is widened until it has passed the last list wanted.
        """
        count, width = len(self.centroids), 32
        while True:
            found = self.search(vector, min(count, width))
            taken, held = [], 0
            for distance, c in found:
                if distance > reach.ratio * max(found[0][0], reach.usual) and held >= least:
                    return taken
                taken.append(c)
                held += int(sizes[c])
            if width >= count:
                return taken
            width *= 4


def probe_reach(
    graph: CentroidGraph, stored: np.ndarray, asking: np.ndarray, neighbours: int
) -> Reach:
    """The least ratio that leads ``TARGET`` of the sample's neighbours to be probed.

    ``stored`` are vectors of the sample in the space of the centroids, ``asking`` the same
    rows as queries. Each neighbour of a trial vector asks for the ratio at which the
    nearest of its lists is probed.
    """
    trials = np.unique(np.linspace(0, len(stored) - 1, TRIALS).astype(int))
    count = min(neighbours, len(stored) - 1)
    norms = (graph.centroids**2).sum(axis=1)
    own = (asking[trials] ** 2).sum(axis=1)[:, None]
    far = np.sqrt(np.maximum(norms - 2 * asking[trials] @ graph.centroids.T + own, 0))
    nearest = far.min(axis=1)
    usual = max(float(np.median(nearest)), 1e-300)
    known: dict[int, list[int]] = {}
    wanted = [1.0]
    for trial, away, base in zip(trials.tolist(), far, nearest):
        scores = stored @ asking[trial]
        scores[trial] = -np.inf
        for row in np.argpartition(scores, -count)[-count:].tolist() if count else []:
            if row not in known:
                known[row] = graph.lists_of(stored[row])
            wanted.append(away[known[row]].min() / max(base, usual))
    return Reach(float(np.quantile(wanted, TARGET)) * (1 + 1e-9), usual)


def balanced_centroids(sample: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of lists of like sizes: nearness is charged with the size of a list.

    A charge grows by steps no larger than a list is wide, and centroids of nearly empty
    lists move into the largest ones, so that a dense cluster is split. The charge is one
    more coordinate of a centroid, in which vectors are zero, so it also holds for vectors
    and queries outside the sample.
    """
    rng = np.random.default_rng(7)
    distinct = np.unique(sample, axis=0)
    count = max(1, min(count, len(distinct)))
    centroids = distinct[rng.choice(len(distinct), count, replace=False)]
    charge = np.zeros(count)
    spread = float(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).mean())
    norms, fair = (sample**2).sum(axis=1), len(sample) / count
    for _ in range(rounds):
        cost = (centroids**2).sum(axis=1) + charge
        owner = np.concatenate([
            (cost - 2 * sample[part] @ centroids.T).argmin(axis=1)
            for part in _blocks(len(sample), count)
        ])
        sizes = np.bincount(owner, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
        width = np.bincount(owner, norms, count) / np.maximum(sizes, 1) - (centroids**2).sum(axis=1)
        step = np.where(full, np.clip(width, 0, spread), 0)
        charge += 0.05 * step * np.clip(sizes / fair - 1, -1, 1)
        for spare in np.flatnonzero(sizes < fair / 4):
            largest = sizes.argmax()
            if sizes[largest] < 2 * fair:
                break
            centroids[spare] = sample[rng.choice(np.flatnonzero(owner == largest))]
            charge[spare] = charge[largest]
            sizes[largest] //= 2
    return np.column_stack([centroids, np.sqrt(charge - charge.min())])


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: vectors that are finite and not zero."""
    vector = F.col("embedding").cast("array<double>")
    plain = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    odd = F.exists(
        "vector",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return plain.filter(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & ~F.coalesce(odd, F.lit(True))
        & F.exists("vector", lambda x: x != 0)
    )


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows of ``width``, that of the longest if not given.

    Missing components are zero, components beyond the width are left out.
    """
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(flat.offsets.to_numpy())
    if len(sizes) and (sizes == sizes[0]).all() and width in (None, int(sizes[0])):
        return values.reshape(len(sizes), -1)
    width = int(sizes.max(initial=0)) if width is None else width
    places = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    matrix = np.zeros((len(sizes), width))
    matrix[rows[places < width], places[places < width]] = values[places < width]
    return matrix


def _level(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Stored vectors in the space of the centroids: of one length, and not charged."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))
    return np.column_stack([vectors, rest, np.zeros(len(vectors))])


def _asking(vectors: np.ndarray) -> np.ndarray:
    """Queries in the space of the centroids."""
    return np.column_stack([vectors, np.zeros((len(vectors), 2))])


def _chunks(counts: np.ndarray, most: int) -> Column:
    """How many chunks of ``most`` rows the rows of column ``block`` are cut into."""
    numbers = [max(1, ceil(n / most)) for n in counts.tolist()]
    return F.get(F.array(*[F.lit(n) for n in numbers]), F.col("block"))


def _sizes(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """Rows for each list or block; at most ``MOST_LISTS`` counts come to the driver."""
    counts = np.zeros(size, int)
    for row in rows.groupBy(column).agg(F.count("*").alias("n")).collect():
        counts[row[column]] = row["n"]
    return counts


def blocks_of(centroids: np.ndarray, held: np.ndarray, most: int) -> np.ndarray:
    """The block of each list: lists near each other, of about ``most`` vectors in all.

    Centroids are grouped by centroids of their own. A query meets a block once, and its
    best there are found before anything is shuffled.
    """
    wanted = ceil(1.5 * held.sum() / most)
    plain = centroids[:, :-1]
    over = balanced_centroids(plain, wanted)
    norms = (over**2).sum(axis=1)
    return np.concatenate([
        (norms - 2 * plain[part] @ over[:, :-1].T).argmin(axis=1)
        for part in _blocks(len(plain), len(over))
    ])


@dataclass
class Search:
    """Vectors in their lists, and queries at the lists that they probe."""

    posted: DataFrame  # row, vec_id, vector, list
    probed: DataFrame  # query_row, query_id, query, block, lists
    rows: int
    queries: int
    held: np.ndarray  # vectors in each list
    block: np.ndarray  # of each list
    chunk_rows: int

    def figures(self) -> dict[str, float]:
        """Copies of a vector, lists, and the share of all rows that a query is scored with."""
        asked = _sizes(self.probed.select(F.explode("lists").alias("list")), "list", len(self.held))
        return {
            "lists": len(self.held),
            "copies": float(self.held.sum()) / self.rows,
            "scored": float((self.held * asked).sum()) / max(1, self.queries) / self.rows,
        }


def search_lists(
    table: DataFrame, neighbours: int = NEIGHBOURS, query_step: int = QUERY_STEP
) -> Search | None:
    """Fit centroids and ratio, and send vectors and queries to their lists.

    None if no vector takes part.
    """
    work = WorkTables(table.sparkSession, "neighbours")
    # numbers are written with the rows, so that they stay the same for every later reader
    numbered = usable(table).withColumn("row", F.monotonically_increasing_id())
    vectors = work.write(numbered, "vectors")
    # one row for each length that occurs; the longest of the most frequent guides the search
    usual = (
        vectors.groupBy(F.size("vector").alias("size"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.desc("size"))
        .first()
    )
    if usual is None:
        return None
    width = usual["size"]
    head = F.slice("vector", 1, width)
    square = F.aggregate(head, F.lit(0.0), lambda total, x: total + x * x)
    asks = F.col("vec_id") % query_step == 0
    rows, queries, longest = vectors.agg(F.count("*"), F.count_if(asks), F.max(square)).first()
    longest = float(np.sqrt(longest))
    most = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * width)))
    chosen = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) <= int(min(1.0, most / rows) * (1 << 20))
    # bounded, see SAMPLE_ROWS and SAMPLE_BYTES
    taken = vectors.filter(chosen).select("row", head.alias("vector")).toArrow()
    sample = _matrix(taken.sort_by("row")["vector"], width)
    stored, asking = _level(sample, longest), _asking(sample)
    lists = max(1, min(MOST_LISTS, rows // LIST_ROWS, len(sample) // SAMPLE_PER_LIST))
    graph = CentroidGraph.over(balanced_centroids(stored[:, :-1], lists))
    # of the neighbours sought, the sample holds its share
    reach = probe_reach(graph, stored, asking, max(1, round(neighbours * len(sample) / rows)))
    # MOST_LISTS rows at most, and an eighth of SAMPLE_BYTES
    shared = table.sparkSession.sparkContext.broadcast((graph.centroids, graph.links))

    def post(batches):
        own = CentroidGraph(*shared.value)
        for batch in batches:
            level = _level(_matrix(batch["vector"], width), longest)
            found = pa.array([own.lists_of(v) for v in level], pa.list_(pa.int32()))
            columns = [batch["row"], batch["vec_id"], batch["vector"], found]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "vector", "lists"])

    fields = "row long, vec_id long, vector array<double>, lists array<int>"
    posted = vectors.select("row", "vec_id", "vector").repartition("row").mapInArrow(post, fields)
    posted = work.write(
        posted.select("row", "vec_id", "vector", F.explode("lists").alias("list")), "posted"
    )
    held = _sizes(posted, "list", len(graph.centroids))
    chunk_rows = max(1, CHUNK_BYTES // (8 * width))
    block = blocks_of(graph.centroids, held, chunk_rows)
    least = LEAST_CANDIDATES * neighbours

    def probe(batches):
        own = CentroidGraph(*shared.value)
        for batch in batches:
            visits = []
            for vector in _asking(_matrix(batch["vector"], width)):
                at: dict[int, list[int]] = {}
                for c in own.probes(vector, held, least, reach):
                    at.setdefault(int(block[c]), []).append(c)
                visits.append([{"block": k, "lists": v} for k, v in at.items()])
            kind = pa.list_(pa.struct([("block", pa.int32()), ("lists", pa.list_(pa.int32()))]))
            columns = [batch["row"], batch["vec_id"], batch["vector"], pa.array(visits, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "vector", "visits"])

    visits = "visits array<struct<block:int,lists:array<int>>>"
    probed = vectors.filter(asks).select("row", "vec_id", "vector").repartition("row")
    probed = work.write(
        probed.mapInArrow(probe, f"row long, vec_id long, vector array<double>, {visits}").select(
            F.col("row").alias("query_row"),
            F.col("vec_id").alias("query_id"),
            F.col("vector").alias("query"),
            F.inline("visits"),
        ),
        "probed",
    )
    return Search(posted, probed, rows, queries, held, block, chunk_rows)


def nearest(
    table: DataFrame, neighbours: int = NEIGHBOURS, query_step: int = QUERY_STEP
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest vectors found for each query.

    Queries are the rows whose vec_id is a multiple of ``query_step``; candidates are all
    other rows. Nearest first, ties to the smaller vec_id; a query gets all candidates if
    there are fewer than ``neighbours``. Vectors that are null, empty, zero, or hold a null
    or non-finite component take no part, nor do rows without vec_id. Rows count one by one:
    repeated rows, or rows that share a vec_id, are candidates of each other, and each query
    among them has a list of its own. Components that the shorter of two vectors lacks are
    zero.
    """
    search = search_lists(table, neighbours, query_step)
    if search is None:
        return table.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double"
        )
    # both sides of a long block are cut into chunks, and each chunk meets each other
    blocks = int(search.block.max()) + 1
    block = F.get(F.array(*[F.lit(n) for n in search.block.tolist()]), F.col("list"))
    vectors_in = np.bincount(search.block, search.held, blocks)
    queries_in = _sizes(search.probed, "block", blocks)
    held = _chunks(vectors_in, search.chunk_rows)
    asked = _chunks(queries_in, ceil(search.chunk_rows / QUERY_PARTS))
    stored = search.posted.withColumn("block", block).select(
        "*",
        F.pmod(F.xxhash64("row"), held).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), asked - 1)).alias("part"),
    )
    asking = search.probed.select(
        "*",
        F.pmod(F.xxhash64("query_row"), asked).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), held - 1)).alias("chunk"),
    )

    def score(key: tuple, held: pa.Table, asking: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}
        if held.num_rows and asking.num_rows:
            held = held.sort_by("list")
            lists = held["list"].to_numpy()
            rows, ids = held["row"].to_numpy(), held["vec_id"].to_numpy()
            vectors, questions = _matrix(held["vector"]), _matrix(asking["query"])
            width = min(vectors.shape[1], questions.shape[1])
            vectors, questions = vectors[:, :width], questions[:, :width]
            reach = np.sqrt((vectors**2).sum(axis=1).max())
            names = zip(*(asking[name].to_pylist() for name in ("query_row", "query_id", "lists")))
            for (query_row, query_id, probed), query in zip(names, questions):
                wanted = np.sort(np.array(probed))
                starts, ends = np.searchsorted(lists, wanted), np.searchsorted(lists, wanted, "right")
                near = np.concatenate([vectors[a:b] @ query for a, b in zip(starts, ends)])
                place = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
                other = rows[place] != query_row
                near, place = near[other], place[other]
                most = REPLICAS * neighbours  # a row may stand in so many lists
                if len(near) > most:
                    # products differ from the exact sums in their last digits
                    slack = 1e-9 * reach * np.sqrt((query**2).sum())
                    place = place[near >= np.partition(near, -most)[-most] - slack]
                place = place[np.unique(rows[place], return_index=True)[1]]
                scores = (vectors[place] * query).sum(axis=1)
                best = np.lexsort((rows[place], ids[place], -scores))[:neighbours]
                found["query_row"] += [query_row] * len(best)
                found["query_id"] += [query_id] * len(best)
                found["row"] += rows[place[best]].tolist()
                found["vec_id"] += ids[place[best]].tolist()
                found["score"] += scores[best].tolist()
        kinds = {"score": pa.float64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()})

    scored = (
        stored.groupBy("block", "chunk", "part")
        .cogroup(asking.groupBy("block", "chunk", "part"))
        .applyInArrow(score, "query_row long, query_id long, row long, vec_id long, score double")
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    # a vector found in several lists has the same score in each
    return (
        scored.groupBy("query_row", "query_id", "row", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= neighbours)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
