"""Benchmark decontamination: containment search for short items in long documents.

An item is found in a document that holds at least ``THRESHOLD`` of the item's word
shingles. Equality of minima, as between sets of like size, does not find a short item in
a document a thousand times its size, so the sketch is that of containment MinHash: the
item's least shingle hashes, each looked up among all hashes of the document. Items are
partitioned by size. The items of a partition share a sketch size, large enough that even
the largest of them, at the threshold, cannot miss its whole sketch; documents with fewer
shingles than a partition needs are not searched for it. Candidates are then verified by
exact containment of shingles. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.sources.storage import WorkTables

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 500_000  # a longer list of sketch hashes or digests is joined by shuffle


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""
    )


def text_digest(text: Column) -> Column:
    """MD5 of a text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def small(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcast if it has no more than ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _windows(values: Column, size: int, join) -> Column:
    """``join`` of every ``size`` neighbours of an array."""
    last = F.size(values) - size
    places = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(places, lambda i: join([F.element_at(values, i + k) for k in range(size)]))


def shingle_hashes(hashes: Column, size: int) -> Column:
    return _windows(hashes, size, lambda parts: F.xxhash64(*parts))


def shingle_texts(values: Column, size: int) -> Column:
    return F.array_distinct(_windows(values, size, lambda parts: F.concat_ws(" ", *parts)))


def hashed_words(values: Column) -> Column:
    return F.transform(values, lambda w: F.xxhash64(w))


def _by_size(shingles, size: Column) -> Column:
    """``shingles(k)`` for the shingle length k in a column, 1 to 5."""
    found = F.when(size == SHINGLE, shingles(SHINGLE))
    for k in range(1, SHINGLE):
        found = found.when(size == k, shingles(k))
    return found


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, size, needed, hash): the sketch of each item, one row per hash.

    ``size`` is the shingle length of the item: 5, or all its words if it has fewer. The
    partition of an item is the power of two of its shingle count; ``needed`` is how many
    shingles the smallest item of the partition must find.
    """
    numbered = items.select(
        F.col("item_id").cast("long").alias("item_id"),
        hashed_words(words(F.col("text"))).alias("hashes"),
    ).withColumn("size", F.least(F.lit(SHINGLE), F.size("hashes")))
    shingles = F.array_distinct(
        _by_size(lambda size: shingle_hashes(F.col("hashes"), size), F.col("size"))
    )
    counted = (
        numbered.filter("size > 0")
        .withColumn("shingles", shingles)
        .withColumn("partition", F.floor(F.log2(F.size("shingles"))).cast("int"))
    )
    largest = F.pow(F.lit(2), F.col("partition") + 1) - 1
    sketch = (F.floor(largest * (1 - threshold) + 1e-9) + 1).cast("int")
    needed = F.ceil(F.pow(F.lit(2), "partition") * threshold - 1e-9).cast("int")
    return counted.select(
        "item_id",
        "size",
        needed.alias("needed"),
        F.explode(F.slice(F.array_sort("shingles"), 1, sketch)).alias("hash"),
    )


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """(digest, item_id, matched, shingles): the texts that hold items.

    ``digest`` is that of the text, so copies of a text are checked once and rows
    without a usable doc_id are found too. ``matched`` of the item's ``shingles`` distinct
    shingles are in the text. Items with fewer words than a shingle are one shingle;
    null and wordless items match nothing.
    """
    work = WorkTables(docs.sparkSession, "decontamination")
    sketches = work.write(item_sketches(items, threshold), "sketches")
    sizes = sorted(r["size"] for r in sketches.select("size").distinct().collect())  # 1 .. 5
    probes = small(sketches)
    hashed = docs.select(
        text_digest(F.col("text")).alias("digest"),
        hashed_words(words(F.col("text"))).alias("hashes"),
    )
    candidates = None
    for size in sizes:
        found = (
            hashed.select(
                "digest", F.array_distinct(shingle_hashes(F.col("hashes"), size)).alias("shingles")
            )
            # outer, as a plain explode infers a filter on the array that is pushed down to
            # the scan and there works the words out again for every shingle
            .select(
                "digest", F.size("shingles").alias("held"), F.explode_outer("shingles").alias("hash")
            )
            .join(probes.filter(F.col("size") == size), "hash")
            .filter(F.col("held") >= F.col("needed"))
            .select("digest", "item_id")
        )
        candidates = found if candidates is None else candidates.unionByName(found)
    if candidates is None:
        empty = "digest string, item_id long, matched int, shingles int"
        return docs.sparkSession.createDataFrame([], empty)
    candidates = work.write(candidates.distinct(), "candidates")
    return _verified(work, docs, items, candidates, threshold)


def _verified(
    work: WorkTables, docs: DataFrame, items: DataFrame, candidates: DataFrame, threshold: float
) -> DataFrame:
    """Candidates whose texts hold enough of the item's shingles, by the shingles themselves."""
    # one text of each digest; few texts have a candidate
    held = (
        docs.select(text_digest(F.col("text")).alias("digest"), "text")
        .join(small(candidates.select("digest").distinct()), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.first("text").alias("text"))
        .select("digest", words(F.col("text")).alias("words"))
    )
    own = items.select(
        F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("item_words")
    )
    size = F.least(F.lit(SHINGLE), F.size("item_words"))
    compared = (
        candidates.join(own, "item_id")
        .withColumn(
            "item_shingles", _by_size(lambda k: shingle_texts(F.col("item_words"), k), size)
        )
        .join(held, "digest")
        .withColumn(
            "matched",
            F.size(
                F.array_intersect(
                    "item_shingles", _by_size(lambda k: shingle_texts(F.col("words"), k), size)
                )
            ),
        )
        .select("digest", "item_id", "matched", F.size("item_shingles").alias("shingles"))
    )
    # written before it is filtered, or the filter is pushed into the joins
    return work.write(compared, "compared").filter(
        F.col("matched") >= F.lit(threshold) * F.col("shingles") - 1e-9
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they are.

    Null and empty texts hold none; copies go together; an empty benchmark removes nothing.
    """
    work = WorkTables(docs.sparkSession, "contaminated")
    found = work.write(contaminated(docs, items, threshold).select("digest").distinct(), "digests")
    return docs.join(small(found), text_digest(docs["text"]) == found["digest"], "left_anti")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, matched, shingles, containment), a row for each item a document holds.

    Repeated document rows give repeated result rows; other columns are not read.
    """
    work = WorkTables(docs.sparkSession, "leaks")
    found = work.write(contaminated(docs, items, threshold), "found")
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest")
    )
    return own.join(small(found), "digest").select(
        "doc_id",
        "item_id",
        F.col("matched").cast("long").alias("matched"),
        F.col("shingles").cast("long").alias("shingles"),
        (F.col("matched") / F.col("shingles")).alias("containment"),
    )
