"""Iterative graph algorithms as loops of joins and aggregates.

Every round ends in a written table, so plans stay short and a lost executor
costs at most one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from random import Random

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from utxolens.functions.hot_keys import DEAL, join_back
from utxolens.session import shuffle_partitions
from utxolens.sources.storage import WorkTables

RESET = 0.15
ROUNDS_PER_TABLE = 5
LIST_SIZE = 1_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of undirected ``edges`` (src, dst).

    The component is its smallest id. In each round every node goes over to its smallest
    neighbour, in an order that differs from round to round, and the graph is contracted
    to the nodes gone over to. A link then has half a chance to let its end go, so the
    nodes shrink by a constant factor per round and all rounds together move a few times
    the links, however long the paths. No node gathers its neighbours: it learns the
    smallest from a map-side combined minimum, and the links of a hub meet that minimum
    in several tasks.
    """
    work = WorkTables(edges.sparkSession, "components")
    apart = F.col("src") != F.col("dst")
    links, rows = _counted(work, edges.select("src", "dst").filter(apart), "links")
    # said of every table of links: plans that read one twice then filter it alike
    present = F.col("src").isNotNull() & F.col("dst").isNotNull()
    levels = []
    while rows:
        seed = Random(len(levels)).getrandbits(63)
        hooked = work.write(_hooked(links.filter(present), seed), "hooked")
        levels.append(hooked)
        following, rows = _counted(work, _contracted(links, hooked), "links")
        work.drop(links)
        links = following
    if not levels:
        return links.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    found = levels.pop()
    while levels:
        further = found.select(F.col("id").alias("root"), F.col("root").alias("further"))
        found = join_back(levels.pop(), further, "root", how="left").select(
            "id", F.coalesce("further", "root").alias("root")
        )
    # stars around some member by now, which is one of the ids itself
    found = work.write(found, "found")
    smallest = found.groupBy("root").agg(F.min("id").alias("component"))
    return join_back(found, smallest, "root").select("id", "component")


def _counted(work: WorkTables, df: DataFrame, label: str) -> tuple[DataFrame, int]:
    observation = Observation()
    table = work.write(df.observe(observation, F.count(F.lit(1)).alias("rows")), label)
    return table, observation.get["rows"]


def _hooked(links: DataFrame, seed: int) -> DataFrame:
    """(id, root): the node a node goes over to, two steps down from it. Nodes are ordered
    by their number with the bits of ``seed`` flipped, so no step leads back up."""
    place = lambda name: F.col(name).bitwiseXOR(F.lit(seed))
    smallest = (
        links.select(F.col("src").alias("id"), place("dst").alias("place"))
        .unionByName(links.select(F.col("dst").alias("id"), place("src").alias("place")))
        .groupBy("id")
        .agg(F.min("place").alias("place"))
        .select("id", F.least(F.col("place"), place("id")).bitwiseXOR(F.lit(seed)).alias("root"))
    )
    further = smallest.select(F.col("id").alias("root"), F.col("root").alias("further"))
    return join_back(smallest, further, "root").select("id", F.col("further").alias("root"))


def _contracted(links: DataFrame, hooked: DataFrame) -> DataFrame:
    """Links between the roots of their ends, once each."""
    for end in ("src", "dst"):
        named = hooked.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
        links = join_back(links, named, end).drop(end)
    return (
        links.filter(F.col("src_root") != F.col("dst_root"))
        .select(F.least("src_root", "dst_root").alias("src"), F.greatest("src_root", "dst_root").alias("dst"))
        .distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on its smallest one."""
    both = links.select(F.col("low").alias("node"), F.col("high").alias("other")).unionByName(
        links.select(F.col("high").alias("node"), F.col("low").alias("other"))
    )
    smallest = both.groupBy("node").agg(F.min("other").alias("other"))
    centre = smallest.select(
        F.col("node").alias("low"), F.least("node", "other").alias("centre")
    )
    # repeats are left to the small-star step that follows
    return join_back(links, centre, "low").select("high", F.col("centre").alias("low"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest one."""
    centre = links.groupBy("high").agg(F.min("low").alias("centre"))
    moved = (
        join_back(links, centre, "high")
        .filter(F.col("low") != F.col("centre"))
        .select(F.col("low").alias("high"), F.col("centre").alias("low"))
    )
    own = centre.select("high", F.col("centre").alias("low"))
    return own.unionByName(moved).distinct()


# ---------------------------------------------------------------- page rank


def edge_weights(edges: DataFrame) -> DataFrame:
    """Edges with weight 1 / out-degree of their source."""
    return _dealt_weights(edges).select("src", "dst", "weight")


def _dealt_weights(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.count("*").alias("out_degree"))
    dealt = join_back(edges.select("src", "dst"), out, "src", keep=True)
    return dealt.withColumn("weight", F.lit(1.0) / F.col("out_degree"))


def target_lists(edges: DataFrame, size: int = LIST_SIZE) -> DataFrame:
    """(id, weight, targets): :func:`edge_weights` with the targets of a source as arrays of
    about ``size`` at most, so that a round moves and sorts sources instead of edges. A
    source with more has several, which its rank meets one by one."""
    parts = F.when(F.col("out_degree") <= size, 1).otherwise(F.ceil(F.col("out_degree") * 2 / size))
    return (
        _dealt_weights(edges)
        .withColumn("part", F.pmod(F.xxhash64("dst"), parts))
        # sources lie together already, and the deal follows from the source
        .groupBy("src", DEAL, "part", "weight")
        .agg(F.collect_list("dst").alias("targets"))
        .select(F.col("src").alias("id"), "weight", "targets")
    )


def _vertices(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.col("src").alias("id"))
        .unionByName(edges.select(F.col("dst").alias("id")))
        .distinct()
    )


def _listed_vertices(lists: DataFrame) -> DataFrame:
    return lists.select("id").unionByName(lists.select(F.explode("targets").alias("id"))).distinct()


def _received(ranks: DataFrame, lists: DataFrame, reset: float, keys: list[str]) -> DataFrame:
    """What the targets of each vertex get from it in a round."""
    given = (F.col("rank") * F.col("weight") * (1 - reset)).alias("rank")
    met = ranks.select(*keys, "rank").join(lists, "id").select(*keys[1:], given, "targets")
    # without rank there is nothing to give
    return met.filter(F.col("rank") != 0).select(F.explode("targets").alias("id"), *keys[1:], "rank")


def _rank_step(
    ranks: DataFrame, lists: DataFrame, base: DataFrame, reset: float, keys: list[str]
) -> DataFrame:
    """One round: rank from the sources of a vertex, plus its own reset mass.
    ``base`` has the reset mass. It is a stored table, so that a chain of rounds
    refers to the round before it only once.
    """
    kept = base.select(*keys, F.col("base").alias("rank"))
    return (
        _received(ranks, lists, reset, keys)
        .unionByName(kept)
        .groupBy(*keys)
        .agg(F.sum("rank").alias("rank"))
    )


@contextmanager
def _lying_by(key: str, table: DataFrame) -> Iterator[DataFrame]:
    """The table on the executors' disks, dealt and sorted by a key. A loop that joins it
    on that key again and again moves only what it joins it with."""
    parts = shuffle_partitions(table.sparkSession)
    placed = table.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)
    try:
        yield placed
    finally:
        placed.unpersist()


def _next_ranks(ranks: DataFrame, lists: DataFrame, base: Column, reset: float) -> DataFrame:
    """(id, rank, before) after one round over a stored table of ranks. It is moved once for
    both joins, the sums lie by id already, and ``base`` follows from the id."""
    received = (
        _received(ranks, lists, reset, ["id"]).groupBy("id").agg(F.sum("rank").alias("received"))
    )
    rank = base + F.coalesce("received", F.lit(0.0))
    return ranks.join(received, "id", "left").select("id", rank.alias("rank"), F.col("rank").alias("before"))


def _rank_rounds(
    work: WorkTables,
    ranks: DataFrame,
    lists: DataFrame,
    base: DataFrame,
    rounds: int,
    reset: float,
    keys: list[str],
) -> DataFrame:
    for round_nr in range(1, rounds + 1):
        ranks = _rank_step(ranks, lists, base, reset, keys)
        if round_nr % ROUNDS_PER_TABLE == 0 or round_nr == rounds:
            ranks = work.write(ranks, "ranks")
    return ranks


def _normalised(ranks: DataFrame, total: Column, source: str | None = None) -> DataFrame:
    """Scale the ranks of each source to ``total``."""
    if source is None:
        mass = ranks.agg(F.sum("rank").alias("mass"))
        return ranks.select("id", (F.col("rank") * total / mass.scalar()).alias("pagerank"))
    mass = ranks.groupBy(source).agg(F.sum("rank").alias("mass"))
    # as many rows as there are sources
    return ranks.join(F.broadcast(mass), source).select(
        source, "id", (F.col("rank") * total / F.col("mass")).alias("pagerank")
    )


def pagerank(
    edges: DataFrame,
    max_iter: int | None = None,
    tol: float | None = None,
    reset: float = RESET,
    source=None,
) -> DataFrame:
    """(id, pagerank) of a directed graph; give ``max_iter`` or ``tol``.

    Ranks start at 1 and are scaled at the end so that they add up to the number
    of vertices. With ``source`` the reset mass goes to that vertex alone and the
    ranks add up to 1. ``tol`` stops when no rank moves by more than it.
    """
    if (max_iter is None) == (tol is None):
        raise ValueError("give either max_iter or tol")
    work = WorkTables(edges.sparkSession, "pagerank")
    lists = work.write(target_lists(edges), "lists")
    start = F.lit(1.0)
    if source is not None:
        start = F.when(F.col("id") == F.lit(source), 1.0).otherwise(0.0)
    ranks = work.write(_listed_vertices(lists).select("id", start.alias("rank")), "ranks")
    round_nr, moved = 0, None
    with _lying_by("id", lists) as near:
        while round_nr < max_iter if tol is None else moved is None or moved > tol:
            round_nr += 1
            step = _next_ranks(ranks, near, start * reset, reset)
            if tol is not None:
                observation = Observation()
                change = F.max(F.abs(F.col("rank") - F.col("before"))).alias("moved")
                step = step.observe(observation, change)
            following = work.write(step.select("id", "rank"), "ranks")
            work.drop(ranks)
            ranks = following
            if tol is not None:
                moved = observation.get["moved"] or 0.0
    if source is not None:
        return _normalised(ranks, F.lit(1.0))
    vertices = ranks.agg(F.count("*").cast("double")).scalar()
    return _normalised(ranks, vertices)


def parallel_personalized_pagerank(
    edges: DataFrame, sources: list, max_iter: int, reset: float = RESET
) -> DataFrame:
    """(source_id, id, pagerank) for several sources at once.

    Only vertices a source has reached have a row for it.
    """
    work = WorkTables(edges.sparkSession, "pagerank-sources")
    lists = work.write(target_lists(edges), "lists")
    base = work.write(
        _listed_vertices(lists)
        .filter(F.col("id").isin(sources))
        .select(
            "id",
            F.col("id").alias("source_id"),
            F.lit(1.0).alias("rank"),
            F.lit(reset).alias("base"),
        ),
        "base",
    )
    keys = ["id", "source_id"]
    ranks = base.select(*keys, "rank")
    ranks = _rank_rounds(work, ranks, lists, base, max_iter, reset, keys)
    return _normalised(ranks, F.lit(1.0), "source_id")


# ---------------------------------------------------------------- triangles


def triangle_count(edges: DataFrame) -> DataFrame:
    """(id, count) of undirected triangles through each vertex.

    Each undirected edge points from the end of lower degree to the one of higher
    degree, so no vertex has more than about sqrt(2 * edges) outgoing edges: a hub
    has the fewest, and the pairs tried stay below edges ** 1.5.
    """
    work = WorkTables(edges.sparkSession, "triangles")
    links = (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))
        .distinct()
    )
    ends = links.select(F.explode(F.array("low", "high")).alias("id"), "low", "high")
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    low = degree.select(F.col("id").alias("low"), F.col("degree").alias("low_degree"))
    high = degree.select(F.col("id").alias("high"), F.col("degree").alias("high_degree"))
    forward = F.struct("low_degree", "low") < F.struct("high_degree", "high")
    pointed = work.write(
        join_back(join_back(links, low, "low"), high, "high").select(
            F.when(forward, F.col("low")).otherwise(F.col("high")).alias("a"),
            F.when(forward, F.col("high")).otherwise(F.col("low")).alias("b"),
        ),
        "pointed",
    )
    second = pointed.select(F.col("a").alias("b"), F.col("b").alias("c"))
    closing = pointed.select("a", F.col("b").alias("c"))
    triangles = pointed.join(second, "b").join(closing, ["a", "c"])
    corners = triangles.select(F.explode(F.array("a", "b", "c")).alias("id"), F.lit(1).alias("one"))
    nothing = pointed.select(F.explode(F.array("a", "b")).alias("id"), F.lit(0).alias("one"))
    return (
        corners.unionByName(nothing).groupBy("id").agg(F.sum("one").alias("count"))
    )


# ---------------------------------------------------------------- strong components


def _mixed(number: Column, seed: int) -> Column:
    """A one-to-one scramble of 64-bit numbers (xorshift), to order vertices at random."""
    x = number.bitwiseXOR(F.lit(seed))
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def _reach_labels(work: WorkTables, edges: DataFrame, seed: int) -> DataFrame:
    """(id, ahead, behind): the smallest scrambled id that reaches a vertex, and the
    smallest one it reaches.

    Besides asking its neighbours, a vertex takes over the label of the vertex its
    label stands for, which doubles the distance covered per round. Only vertices whose
    label has changed tell their neighbours, who know the label before already.
    """
    # labels are scrambled ids, so that is how a label finds its vertex
    key = _mixed(F.col("id"), seed)
    moved = [F.lit(True).alias(f"{side}_moved") for side in ("ahead", "behind")]
    labels = work.write(
        _vertices(edges).select("id", key.alias("ahead"), key.alias("behind"), *moved), "labels"
    )
    nothing = F.lit(None).cast("long")
    with _lying_by("src", edges) as by_src, _lying_by("dst", edges) as by_dst:
        while True:
            out = by_src.join(
                labels.filter("ahead_moved").select(F.col("id").alias("src"), "ahead"), "src"
            ).select(F.col("dst").alias("id"), "ahead", nothing.alias("behind"))
            back = by_dst.join(
                labels.filter("behind_moved").select(F.col("id").alias("dst"), "behind"), "dst"
            ).select(F.col("src").alias("id"), nothing.alias("ahead"), "behind")
            told = (
                out.unionByName(back)
                .groupBy("id")
                .agg(F.min("ahead").alias("told_ahead"), F.min("behind").alias("told_behind"))
            )
            asked = labels.join(told, "id", "left").select(
                "id",
                F.col("ahead").alias("old_ahead"),
                F.col("behind").alias("old_behind"),
                F.least("ahead", "told_ahead").alias("ahead"),
                F.least("behind", "told_behind").alias("behind"),
            )
            further = labels.select(key.alias("ahead"), F.col("ahead").alias("further_ahead"))
            nearer = labels.select(key.alias("behind"), F.col("behind").alias("further_behind"))
            # a vertex that is its own label has nothing further to tell
            jumped = (
                asked.join(further.filter("ahead != further_ahead"), "ahead", "left")
                .join(nearer.filter("behind != further_behind"), "behind", "left")
                .select(
                    "id",
                    F.least("ahead", "further_ahead").alias("ahead"),
                    F.least("behind", "further_behind").alias("behind"),
                    "old_ahead",
                    "old_behind",
                )
                .select(
                    "id",
                    "ahead",
                    "behind",
                    (F.col("ahead") != F.col("old_ahead")).alias("ahead_moved"),
                    (F.col("behind") != F.col("old_behind")).alias("behind_moved"),
                )
            )
            observation = Observation()
            any_moved = F.max(F.col("ahead_moved") | F.col("behind_moved")).alias("moved")
            following = work.write(jumped.observe(observation, any_moved), "labels")
            work.drop(labels)
            labels = following
            if not observation.get["moved"]:
                return labels


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those at vertices that nothing enters or nothing leaves."""
    entered = edges.select(F.col("dst").alias("src")).distinct()
    left = edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi")


def _strong_rounds(edges: DataFrame):
    """Yield (found, rest) per round: found has (id, component) of the components
    settled, rest the edges that still may lie inside one, with their class."""
    work = WorkTables(edges.sparkSession, "strong")
    rest = work.write(
        _trimmed(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()),
        "edges",
    )
    round_nr = 0
    while not rest.isEmpty():
        round_nr += 1
        labels = _reach_labels(work, rest, 0x5DEECE66D * round_nr)
        # both labels agree only on the vertices that reach that vertex and are
        # reached from it
        found = labels.filter(F.col("ahead") == F.col("behind")).select(
            "id", F.concat_ws("-", F.lit(round_nr), "ahead").alias("component")
        )
        open_labels = labels.filter(F.col("ahead") != F.col("behind")).select(
            "id", "ahead", "behind"
        )
        following = work.write(
            rest.join(open_labels.withColumnRenamed("id", "src"), "src").join(
                open_labels.withColumnRenamed("id", "dst"), ["dst", "ahead", "behind"]
            ),
            "edges",
        )
        yield found, following
        rest = work.write(_trimmed(following.select("src", "dst")), "edges")


def strongly_connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of a directed graph over 64-bit ids.

    The component is its smallest vertex. In each round every vertex learns the
    smallest vertex (in a random order) that reaches it and that it reaches; where
    they agree a component is settled, and no component crosses two classes of
    these labels, so edges between classes are dropped.
    """
    settled = None
    for found, _ in _strong_rounds(edges):
        settled = found if settled is None else settled.unionByName(found)
    vertices = _vertices(edges)
    if settled is None:
        return vertices.withColumn("component", F.col("id"))
    names = settled.groupBy("component").agg(F.min("id").alias("smallest"))
    named = join_back(settled, names, "component").select("id", "smallest")
    return vertices.join(named, "id", "left").select(
        "id", F.coalesce("smallest", "id").alias("component")
    )


def largest_scc(edges: DataFrame) -> DataFrame:
    """One row (scc_size). Stops as soon as no open class is larger than the largest
    component found, since a component lies inside one class."""
    vertices = 0 if edges.isEmpty() else 1
    best = vertices
    for found, rest in _strong_rounds(edges):
        sizes = found.groupBy("component").count()
        best = max(best, sizes.agg(F.max("count")).first()[0] or 0)
        classes = (
            rest.select(F.explode(F.array("src", "dst")).alias("id"), "ahead", "behind")
            .distinct()
            .groupBy("ahead", "behind")
            .count()
        )
        if (classes.agg(F.max("count")).first()[0] or 0) <= best:
            break
    return edges.sparkSession.range(1).select(F.lit(best).cast("long").alias("scc_size"))
