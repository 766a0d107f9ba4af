"""SimHash near-duplicates, with tables of distances to reference fingerprints.

Fingerprints that differ in few bits agree on some of the bands they are cut into, so
fingerprints meet by the bands they share and no link can be missed. Among those that
meet, a table holds the Hamming distances to many reference fingerprints; by the triangle
inequality a pair whose distances to any reference differ by more than the limit is no
link, and is discarded without a look at the fingerprints. Survivors are verified.

Equal fingerprints are one row from the start. Shared bands with many fingerprints are
cut into pairs of chunks, each compared on its own. A task gives the links that connect
what it has compared, not all of them: components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.functions.hot_keys import join_back
from utxolens.llm.decontaminate import small, text_digest
from utxolens.llm.tokens import texts
from utxolens.operators.graph_algorithms import connected_components
from utxolens.sources.storage import WorkTables

SHINGLE = 4
MAX_BITS = 4
SEED = 42
REFERENCES = 16
TASK_ROWS = 50_000
CHUNK = 1_000

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("fingerprint", pa.int64())])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    last = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array(
        [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, last)], "<u8"
    )
    bits = np.zeros(64, np.int64)
    for part in np.array_split(hashes, -(-len(hashes) // 65_536)):
        ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += ones.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(bits * 2 > len(hashes), bitorder="little")
    return int(chosen.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, fingerprint) of every whole text; the number is shown as signed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), shingle) for text in batch["text"]]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["digest"].cast(pa.string()), pa.array(signed)], schema=FINGERPRINTS
            )

    read = texts(docs).withColumn("digest", text_digest(F.col("text")))
    return read.mapInArrow(each, "doc_id long, digest string, fingerprint long")


def bands_for(rows: int, max_bits: int) -> tuple[int, int]:
    """How many bands, and how many of them to join on, for so many fingerprints.

    Any choice finds every link. More bands give longer keys, shared by fewer.
    """
    bands = max_bits + 1
    while bands < max_bits + 4:
        shared = bands - max_bits
        if rows / 2 ** (64 * shared // bands) <= 1:
            break
        bands += 1
    return bands, bands - max_bits


def band_keys(value: Column, bands: int, shared: int) -> Column:
    """Array of keys: each choice of bands with the fingerprint's bits in them."""
    edges = [64 * i // bands for i in range(bands + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(bands), shared)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), value.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def reference_fingerprints(count: int = REFERENCES) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, count, dtype=np.uint64)


def connecting_links(
    keys: np.ndarray, cells: np.ndarray, values: np.ndarray, max_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints within ``max_bits`` that share key and cell."""
    references = reference_fingerprints()
    unsigned = values.view(np.uint64)
    near = np.bitwise_count(unsigned ^ references[0]).astype(np.int16)
    order = np.lexsort((near, cells, keys))
    keys, cells, unsigned = keys[order], cells[order], unsigned[order]
    table = np.bitwise_count(unsigned[:, None] ^ references[None, :]).astype(np.int16)
    # one label for each distinct fingerprint
    names, parent_of = np.unique(unsigned, return_inverse=True)
    parent = np.arange(len(names))
    left: list[int] = []
    right: list[int] = []
    active, shift = np.arange(len(keys)), 0
    while len(active):
        shift += 1
        active = active[active + shift < len(keys)]
        other = active + shift
        # sorted by the distance to the first reference: later rows only get further away
        stay = (
            (keys[active] == keys[other])
            & (cells[active] == cells[other])
            & (table[other, 0] - table[active, 0] <= max_bits)
        )
        active, other = active[stay], other[stay]
        apart = parent[parent_of[active]] != parent[parent_of[other]]
        one, two = active[apart], other[apart]
        passed = np.abs(table[one] - table[two]).max(axis=1, initial=0) <= max_bits
        one, two = one[passed], two[passed]
        linked = np.bitwise_count(unsigned[one] ^ unsigned[two]) <= max_bits
        joined = False
        for a, b in zip(parent_of[one[linked]].tolist(), parent_of[two[linked]].tolist()):
            a_root, b_root = a, b
            while parent[a_root] != a_root:
                a_root = parent[a_root]
            while parent[b_root] != b_root:
                b_root = parent[b_root]
            if a_root != b_root:
                parent[max(a_root, b_root)] = min(a_root, b_root)
                left.append(a)
                right.append(b)
                joined = True
        while joined:
            higher = parent[parent]
            joined = bool((higher != parent).any())
            parent = higher
    signed = names.view(np.int64)
    return signed[np.array(left, np.int64)], signed[np.array(right, np.int64)]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(src, dst) between the distinct ``fingerprint`` values of a written table.

    The links connect exactly what the links of all pairs within ``max_bits`` connect.
    """
    work = WorkTables(distinct.sparkSession, "simhash-links")
    rows = distinct.count()
    bands, shared = bands_for(rows, max_bits)
    keyed = distinct.select("fingerprint", F.explode(band_keys(F.col("fingerprint"), bands, shared)).alias("key"))
    frequent = work.write(
        keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK).select(
            "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")
        ),
        "frequent",
    )
    # a frequent key's chunk meets itself and every other chunk, each pair in a cell
    own = F.pmod(F.xxhash64(F.lit("chunk"), "fingerprint"), F.col("chunks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda c: (F.least(F.col("own"), c) * F.col("chunks") + F.greatest(F.col("own"), c)).cast("long"),
    )
    placed = (
        keyed.join(small(frequent), "key", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", own)
        .select("key", "fingerprint", F.explode(cells).alias("cell"))
    )
    tasks = max(1, ceil(rows * comb(bands, shared) / TASK_ROWS))
    dealt = placed.withColumn("task", F.pmod(F.xxhash64("key", "cell"), F.lit(tasks)))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        src, dst = connecting_links(
            *(table[name].to_numpy().copy() for name in ("key", "cell", "fingerprint")), max_bits
        )
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return dealt.groupBy("task").applyInArrow(compare, "src long, dst long")


def _groups(own: DataFrame, max_bits: int) -> DataFrame:
    """(fingerprint, component, component_id) of the fingerprints of a written table.

    ``component`` is the smallest fingerprint that links reach, ``component_id`` the smallest
    doc_id there, null if no row has one.
    """
    work = WorkTables(own.sparkSession, "simhash-groups")
    distinct = work.write(
        own.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct"
    )
    found = work.write(links(distinct, max_bits), "links")
    linked = work.write(
        connected_components(found)
        .withColumnRenamed("id", "fingerprint")
        .join(distinct, "fingerprint"),
        "linked",
    )
    smallest = work.write(linked.groupBy("component").agg(F.min("first").alias("smallest")), "smallest")
    named = linked.select("fingerprint", "component").join(smallest, "component")
    return work.write(
        distinct.join(named, "fingerprint", "left").select(
            "fingerprint",
            F.coalesce("component", "fingerprint").alias("component"),
            F.coalesce("smallest", "first").alias("component_id"),
        ),
        "components",
    )


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    ``fingerprint`` is 16 hexadecimal digits; ``component_id`` is the smallest doc_id that
    links reach, its own included. Null and wordless texts have fingerprint zero and are
    linked like any other. A row with a null doc_id links others but names no component;
    repeated rows share theirs; an empty table gives no rows; other columns are not read.
    """
    work = WorkTables(docs.sparkSession, "simhash")
    own = work.write(fingerprints(docs, shingle), "fingerprints")
    groups = _groups(own, max_bits).select("fingerprint", "component_id")
    return own.join(groups, "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group that links connect, all columns as they are.

    It is the one with the smallest doc_id, rows without a doc_id coming last; of several
    texts with that doc_id, the one with the smallest digest. Rows are told apart by doc_id
    and text, so a text stays if only another text with its doc_id is a copy of something.
    """
    work = WorkTables(docs.sparkSession, "simhash-dedup")
    own = work.write(fingerprints(docs, shingle), "fingerprints")
    groups = _groups(own, max_bits).select("fingerprint", "component")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    placed = work.write(own.join(groups, "fingerprint").select("component", place.alias("place")), "placed")
    firsts = (
        placed.groupBy("component")
        .agg(F.min("place").alias("first"), F.count("*").alias("rows"))
        .filter("rows > 1")
        .select("component", "first")
    )
    counted = work.write(
        join_back(placed, firsts, "component")
        .groupBy("place", F.col("place").eqNullSafe(F.col("first")).alias("stays"))
        .agg(F.count("*").alias("rows"))
        .select(F.col("place.doc_id").alias("its_id"), F.col("place.digest").alias("its_digest"), "stays", "rows"),
        "counted",
    )
    # the row travels as one value, whatever its columns are called
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("own_id"),
        text_digest(F.col("text").cast("string")).alias("own_digest"),
    )
    same = F.col("own_id").eqNullSafe(F.col("its_id")) & (F.col("own_digest") == F.col("its_digest"))
    kept = rows.join(small(counted.filter("not stays")), same, "left_anti")
    repeated = counted.filter("stays and rows > 1")
    if repeated.isEmpty():
        return kept.select("row.*")
    once = kept.join(small(repeated), same, "left_semi").dropDuplicates(["own_id", "own_digest"])
    return kept.join(small(repeated), same, "left_anti").unionByName(once).select("row.*")
