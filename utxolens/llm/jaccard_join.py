"""Jaccard join of word n-gram sets by PartEnum signatures.

Sets are cut into bands of like sizes (Arasu, Ganti and Kaushik 2006), so that linked sets
lie in one band or in two neighbouring ones. For a pair of such bands the threshold bounds
the number k of elements that only one of two linked sets has. The domain of elements is
partitioned by hash, and each partition into three cells. At most k // 2 partitions can hold
two or more of the k elements; in any other one, the two sets agree on two of the three
cells. A signature names a partition and the content of two of its cells, so linked sets
share one.

There are some partitions more than needed, ``spare`` of them. Linked sets then share
signatures of ``spare`` + 1 partitions, and each set leaves out its ``spare`` poorest
signatures, those with the fewest elements: the richest shared one is always left. Poor
signatures, such as those of empty cells, are the ones that unrelated sets share.

Equal sets are one class from the start. Sets that share a signature are a group. Groups
are tested by centres: a member is compared with all others of another component, and only
where that has left a group in several components do more members follow, in rounds of
1, 2, 4 ... centres, until each group is one component or all of its members were centres.
A group of n sets thus costs n comparisons if they are alike, and no link is lost if not.

A pair is discarded where its sizes differ too much, or where the sketches of the sets do:
a sketch holds for each of 512 shares of the domain whether the number of elements is odd,
so sketches never differ in more places than sets in elements. Each pair left is verified
by the sizes of the sets and of their intersection.

Elements are 64-bit hashes of shingles, classes 64-bit digests of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.functions.hot_keys import join_back
from utxolens.llm.caches import TwoGenerations
from utxolens.llm.decontaminate import small
from utxolens.llm.tokens import texts
from utxolens.operators.graph_algorithms import connected_components
from utxolens.sources.storage import WorkTables

SHINGLE = 4
PERCENT = 85
CELLS = 3
WORDS_KEPT = 400_000
SEEN_KEPT = 500_000
ROWS_OUT = 100_000
OPEN_GROUP = 100_000
SKETCH_WORDS = 8
CENTRES_GROW = 3  # bits: eight times as many centres from round to round

OWN = pa.struct([("doc_id", pa.int64()), ("n", pa.int64())])
SIGNED = pa.schema([("signature", pa.int64()), ("id", pa.int64()), ("own", OWN)])
SIGNED_COLUMNS = "signature long, id long, own struct<doc_id long, n long>"
SETS = pa.schema(
    [("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64())), ("elements", pa.list_(pa.int64()))]
)


# ---------------------------------------------------------------- sets


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit numbers (the finisher of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@cache
def word_hashes() -> TwoGenerations:
    """The word hashes of this worker process."""
    from xxhash import xxh64_intdigest

    return TwoGenerations(xxh64_intdigest, WORDS_KEPT)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``size`` words.

    Words are separated by white space of ASCII, and A-Z are lower-cased. Fewer words are
    one shingle of all of them, no words are no shingle.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    length = min(size, len(words))
    rows = len(hashes) - length + 1
    joined = np.full(rows, length, np.uint64)
    for k in range(length):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + rows]
    return np.unique(mixed(joined))


def class_of(elements: np.ndarray) -> int:
    """A digest of the set, as a signed 64-bit number."""
    total = mixed(elements ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(elements))], np.uint64)).view(np.int64)[0])


# ---------------------------------------------------------------- bands and signatures


@cache
def band_tops(largest: int, percent: int) -> tuple[int, ...]:
    """Largest size of each band, up to the one that holds ``largest``.

    A set is at most 100 / percent times as large as one it links with, and so is the top
    of a band compared with its smallest size.
    """
    tops, low = [], 1
    while not tops or tops[-1] < largest:
        tops.append(max(low, low * 100 // percent))
        low = tops[-1] + 1
    return tuple(tops)


def band_of(size: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """Band of a size, the band's largest size and that of the next band."""
    largest = 1
    while largest < size:
        largest *= 2
    tops = band_tops(largest * 4, percent)
    band = int(np.searchsorted(tops, size))
    return band, tops[band], tops[band + 1]


def most_apart(top: int, percent: int = PERCENT) -> int:
    """Elements that only one of two linked sets may have, if neither is over ``top``."""
    return 2 * top * (100 - percent) // (100 + percent)


def partitions_for(apart: int) -> tuple[int, int]:
    """(partitions, spare): how many there are, and how many beyond the needed ones."""
    needed = apart // 2 + 1
    spare = needed // 8
    return needed + spare, spare


def signatures(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set, for its band with itself and with the band above.

    No signature is made where linked sets are equal ones, which have one class.
    """
    size = len(elements)
    if not size:
        return np.empty(0, np.uint64)
    band, *tops = band_of(size, percent)
    content = mixed(elements ^ np.uint64(0xA0761D6478BD642F))
    running = np.concatenate([[np.uint64(0)], np.cumsum(content, dtype=np.uint64)])
    found = []
    for pair, top in enumerate(tops, band):
        apart = most_apart(top, percent)
        if not apart:
            continue
        count, spare = partitions_for(apart)
        cells = count * CELLS
        # elements are sorted, so each cell is a stretch of them
        place = ((elements >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        edges = np.searchsorted(place, np.arange(cells + 1, dtype=np.uint64))
        inside = (running[edges[1:]] - running[edges[:-1]]).reshape(count, CELLS)
        held = np.diff(edges).reshape(count, CELLS)
        rich = (held.sum(axis=1, keepdims=True) - held).reshape(-1)
        names = np.arange(cells, dtype=np.uint64) + np.uint64(pair << 40)
        # mixed cell by cell, so that the same content in another cell is another signature
        told = mixed(inside + np.arange(1, CELLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        kept = (told.sum(axis=1, keepdims=True, dtype=np.uint64) - told).reshape(-1)
        made = mixed(kept ^ mixed(names))
        if spare:
            made = made[np.argsort(rich, kind="stable")[spare:]]
        found.append(made)
    return np.concatenate(found) if found else np.empty(0, np.uint64)


# ---------------------------------------------------------------- passes over the texts


def _pass(docs: DataFrame, each, schema: str) -> DataFrame:
    """``each(doc_id, text)`` yields record batches for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), t.as_py()) for b in batches for i, t in zip(b["doc_id"], b["text"]))
        yield from each(rows)

    return texts(docs).mapInArrow(run, schema)


def signed_classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(signature, id, own) of all rows, in one pass.

    A row of ``docs`` gives one row with its doc_id and the size of its set as ``own``, under
    a signature that only spreads such rows, and a row per signature of its set, where
    ``own`` is null. Copies within a task are signed once.
    """

    def each(rows) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        made, ids, own_rows, waiting = [], [], [], 0
        for number, (doc_id, text) in enumerate(rows):
            elements = shingle_set(text, size)
            own = class_of(elements)
            own_rows.append((number * 0x9E3779B97F4A7C15 % 2**63, own, doc_id, len(elements)))
            if own not in seen:
                if len(seen) >= SEEN_KEPT:
                    seen.clear()
                seen.add(own)
                found = signatures(elements, percent)
                made.append(found)
                ids.append(np.full(len(found), own))
                waiting += len(found)
            if waiting + len(own_rows) >= ROWS_OUT:
                yield from _signed(made, ids, own_rows)
                made, ids, own_rows, waiting = [], [], [], 0
        yield from _signed(made, ids, own_rows)

    return _pass(docs, each, SIGNED_COLUMNS)


def _rows(signature: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(signature), pa.array(ids), pa.nulls(len(ids), OWN)]
    return pa.RecordBatch.from_arrays(columns, schema=SIGNED)


def _signed(made: list[np.ndarray], ids: list[np.ndarray], own_rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if made:
        yield _rows(np.concatenate(made).view(np.int64), np.concatenate(ids))
    if own_rows:
        spread, own, doc_id, n = (pa.array(column, pa.int64()) for column in zip(*own_rows))
        named = pa.StructArray.from_arrays([doc_id, n], fields=list(OWN))
        yield pa.RecordBatch.from_arrays([spread, own, named], schema=SIGNED)


class _Groups:
    """Rows of whole groups, without those of one class or with members seen before."""

    def __init__(self):
        self.seen: set[tuple[int, int]] = set()

    def chosen(self, signature: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(signature):
            return
        starts = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
        sizes = np.diff(np.append(starts, len(signature)))
        keep = sizes > 1
        totals = np.add.reduceat(mixed(ids.view(np.uint64)), starts)[keep].tolist()
        fresh = []
        for digest in zip(totals, sizes[keep].tolist()):
            fresh.append(digest not in self.seen)
            if len(self.seen) < SEEN_KEPT:
                self.seen.add(digest)
        keep[keep] = fresh
        rows = np.repeat(keep, sizes)
        if rows.any():
            yield _rows(signature[rows], ids[rows])


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and id: the distinct rows of signatures that several
    classes have. Of groups with the same members, one is enough. Rows with an ``own`` value
    are handed on as they are.

    Groups are held until they end; one that grows large is passed on row by row instead.
    """
    groups = _Groups()
    signature, ids = np.empty(0, np.int64), np.empty(0, np.int64)
    passing, last = None, None
    for batch in batches:
        named = batch["own"].is_valid()
        if pc.any(named).as_py():
            yield batch.filter(named)
            batch = batch.filter(pc.invert(named))
        more, more_ids = batch["signature"].to_numpy(), batch["id"].to_numpy()
        if passing is not None:
            own = int(np.searchsorted(more, passing, "right"))
            if own:
                rest = more_ids[:own]
                rest = rest[np.concatenate([[rest[0] != last], rest[1:] != rest[:-1]])]
                last = more_ids[own - 1]
                if len(rest):
                    yield _rows(np.full(len(rest), passing), rest)
            more, more_ids = more[own:], more_ids[own:]
            if not len(more):
                continue
            passing = None
        signature, ids = np.concatenate([signature, more]), np.concatenate([ids, more_ids])
        if not len(signature):
            continue
        new = np.ones(len(signature), bool)
        new[1:] = (signature[1:] != signature[:-1]) | (ids[1:] != ids[:-1])
        signature, ids = signature[new], ids[new]
        first = int(np.searchsorted(signature, signature[-1]))
        yield from groups.chosen(signature[:first], ids[:first])
        signature, ids = signature[first:], ids[first:]
        if len(signature) > max(OPEN_GROUP, 1):
            yield _rows(signature, ids)
            passing, last = signature[0], ids[-1]
            signature, ids = signature[:0], ids[:0]
    yield from groups.chosen(signature, ids)


def sketch_of(elements: np.ndarray) -> np.ndarray:
    """For each share of the domain, a bit that says whether it has an odd number."""
    bits = SKETCH_WORDS * 64
    held = np.bincount((elements % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits(held & 1, bitorder="little").view("<i8")


def sets_of(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, n, sketch, elements) of the rows' sets. Copies within a task are given once."""

    def each(rows) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kept, waiting = [], 0
        for _, text in rows:
            elements = shingle_set(text, size)
            own = class_of(elements)
            if own in seen:
                continue
            if len(seen) >= SEEN_KEPT:
                seen.clear()
            seen.add(own)
            kept.append((own, len(elements), sketch_of(elements), elements.view(np.int64)))
            waiting += len(elements)
            if waiting >= 10 * ROWS_OUT:
                yield _of_sets(kept)
                kept, waiting = [], 0
        if kept:
            yield _of_sets(kept)

    return _pass(docs, each, "id long, n long, sketch array<long>, elements array<long>")


def _of_sets(kept: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(column, field.type) for column, field in zip(zip(*kept), SETS)]
    return pa.RecordBatch.from_arrays(columns, schema=SETS)


# ---------------------------------------------------------------- groups

SKETCH = [f"sketch_{i}" for i in range(SKETCH_WORDS)]


def distinct_groups(members: DataFrame) -> DataFrame:
    """One of all signatures with the same classes."""
    groups = members.groupBy("signature").agg(
        F.count("*").alias("rows"),
        F.bit_xor(F.xxhash64("id")).alias("digest"),
        F.min("id").alias("low"),
        F.max("id").alias("high"),
    )
    return groups.groupBy("rows", "digest", "low", "high").agg(F.min("signature").alias("signature"))


def centres_of(live: DataFrame, round_nr: int) -> DataFrame:
    """One member of each group, eight times as many in each later round: of a share of the
    group by hash, the one that is in most groups."""
    shares = 1 << CENTRES_GROW * round_nr
    share = F.pmod(F.xxhash64("id", F.lit(round_nr)), F.lit(shares).cast("long"))
    columns = ["weight", "id", "n", "component", *SKETCH]
    return (
        live.groupBy("signature", share.alias("share"))
        .agg(F.max(F.struct(*columns)).alias("first"))
        .select("signature", *[F.col(f"first.{name}").alias(f"centre_{name}") for name in columns])
    )


def possible(percent: int = PERCENT) -> Column:
    """Whether sizes and sketches of a member and a centre allow a link."""
    alike = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    apart = F.expr(f"(n + centre_n) * {100 - percent} div {100 + percent}")
    differ = reduce(add, [F.bit_count(F.col(name).bitwiseXOR(F.col(f"centre_{name}"))) for name in SKETCH])
    return alike & (differ <= apart)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (src, dst) of ``pairs`` whose sets reach the threshold."""
    one = sets.select(F.col("id").alias("src"), F.col("elements").alias("one"))
    other = sets.select(F.col("id").alias("dst"), F.col("elements").alias("other"))
    both = pairs.join(one, "src").join(other, "dst")
    common = F.size(F.array_intersect("one", "other"))
    union = F.size("one") + F.size("other") - common
    return both.filter(100 * common >= percent * union).select("src", "dst")


class _Components:
    """Components of classes, as links come in."""

    def __init__(self, work: WorkTables, classes: DataFrame):
        self.work = work
        self.table = work.write(classes.select("id", F.col("id").alias("component")), "components")

    def add(self, links: DataFrame) -> None:
        named = self.table.select(F.col("id").alias("src"), F.col("component").alias("one"))
        other = self.table.select(F.col("id").alias("dst"), F.col("component").alias("two"))
        between = (
            links.join(named, "src")
            .join(other, "dst")
            .select(F.col("one").alias("src"), F.col("two").alias("dst"))
        )
        moved = self.work.write(
            connected_components(between).select(
                F.col("id").alias("component"), F.col("component").alias("into")
            ),
            "moved",
        )
        self.table = self.work.write(
            join_back(self.table, moved, "component", how="left").select(
                "id", F.coalesce("into", "component").alias("component")
            ),
            "components",
        )


def components_of(
    members: DataFrame, sets: DataFrame, work: WorkTables, percent: int = PERCENT
) -> DataFrame:
    """(id, component) of the classes in groups ``members`` (signature, id).

    ``sets`` has each of them once.
    """
    parts = [F.get("sketch", i).alias(name) for i, name in enumerate(SKETCH)]
    told = work.write(
        members.groupBy("id")
        .agg(F.count("*").alias("weight"))
        .join(sets.select("id", "n", *parts), "id"),
        "told",
    )
    components = _Components(work, told)
    groups = work.write(distinct_groups(members), "groups").select("signature")
    kept = join_back(members.select("signature", "id"), groups, "signature", how="left_semi")
    live = work.write(kept.select("signature", "id"), "live")
    tested: DataFrame | None = None
    round_nr = 0
    while not live.isEmpty():
        # what pairs are judged by is looked up anew each round: groups move without it
        known = told.join(components.table, "id")
        named = work.write(join_back(live, known, "id"), "named")
        centres = work.write(centres_of(named, round_nr), "centres")
        pairs = (
            named.join(centres, "signature")
            .filter((F.col("component") != F.col("centre_component")) & possible(percent))
            .select(F.least("id", "centre_id").alias("src"), F.greatest("id", "centre_id").alias("dst"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["src", "dst"], "left_anti")
        pairs = work.write(pairs, "pairs")
        work.drop(named)
        components.add(work.write(verified(pairs, sets, percent), "links"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        used = centres.select("signature", F.col("centre_id").alias("id"))
        rest = live.join(used, ["signature", "id"], "left_anti")
        rest = work.write(join_back(rest, components.table, "id"), "rest")
        work.drop(live)
        groups = rest.groupBy("signature").agg(
            F.min("component").alias("low"), F.max("component").alias("high")
        )
        open_groups = work.write(groups.filter("low != high").select("signature"), "open")
        still = join_back(rest, open_groups, "signature", how="left_semi")
        live = work.write(still.select("signature", "id"), "live")
        work.drop(rest)
        round_nr += 1
    return components.table


def candidate_sets(docs: DataFrame, own: DataFrame, wanted: DataFrame, work: WorkTables, size: int) -> DataFrame:
    """Sets of the ``wanted`` classes, each from a document that has it."""
    firsts = work.write(
        own.groupBy("id").agg(F.min("doc_id").alias("doc_id")).join(wanted, "id"), "firsts"
    )
    named = firsts.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen = docs.join(small(work.write(named, "chosen")), "doc_id", "left_semi")
    if not firsts.filter(F.col("doc_id").isNull()).isEmpty():
        chosen = chosen.unionByName(docs.filter(F.col("doc_id").isNull()))
    sets = work.write(sets_of(chosen, size).join(firsts.select("id"), "id", "left_semi"), "sets")
    # documents with the doc_id of another, or without one, may repeat a class
    repeated = sets.groupBy("id").count().filter("count > 1")
    if repeated.isEmpty():
        return sets
    names = ["n", "sketch", "elements"]
    return work.write(sets.groupBy("id").agg(*[F.any_value(name).alias(name) for name in names]), "sets")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``.

    Sets link if 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest
    doc_id that links reach, the own one included. Null and wordless texts have no shingles
    and link with nothing, not even with each other. A row with a null doc_id links others
    but names no component: it has the smallest doc_id of its component, if there is one.
    Repeated rows share a class. An empty table gives no rows; other columns are not read.
    """
    work = WorkTables(docs.sparkSession, "jaccard")
    docs = texts(docs)
    found = work.write(
        signed_classes(docs, size, percent)
        .repartition("signature")
        .sortWithinPartitions("signature", "id")
        .mapInArrow(shared_only, SIGNED_COLUMNS),
        "signed",
    )
    own = found.filter(F.col("own").isNotNull()).select("own.doc_id", "id", "own.n")
    members = found.filter(F.col("own").isNull()).select("signature", "id")
    classes = work.write(
        own.filter("n > 0").groupBy("id").agg(F.min("doc_id").alias("first")), "classes"
    )
    wanted = work.write(members.select("id").distinct(), "wanted")
    sets = candidate_sets(docs, own, wanted, work, size)
    linked = components_of(members, sets, work, percent)
    named = work.write(
        classes.join(linked, "id", "left").select(
            "id", "first", F.coalesce("component", "id").alias("component")
        ),
        "named",
    )
    smallest = work.write(named.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    found = work.write(join_back(named, smallest, "component").select("id", "component_id"), "found")
    return join_back(own, found, "id", how="left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
