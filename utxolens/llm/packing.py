"""Packing of documents into training sequences.

First-fit decreasing with a tournament tree of bin capacities, run on its own in
randomised groups of documents. A document longer than a sequence is cut into whole
sequences and a rest; rests are packed. The group of a piece is a digest of the piece,
so groups have the same expected size whatever source, language or key is frequent, and
their number follows the number of documents. No group sees another one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.llm.tokens import batches_of, encoding, texts

CAPACITY = 2048
END_ID = 1
GROUP_DOCUMENTS = 2000

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids", pa.binary()),
    ]
)
PACKED = "doc_id long, start long, doc_tokens long, ids binary, sequence_id long, offset long"


class Tournament:
    """Bins in order of their opening; the tree holds the largest rest below a node."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.rest = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """Put ``size`` into the first bin with room and return that bin."""
        rest, node = self.rest, 1
        while node < self.leaves:
            node *= 2
            if rest[node] < size:
                node += 1
        rest[node] -= size
        place = node - self.leaves
        while node > 1:
            node //= 2
            rest[node] = max(rest[2 * node], rest[2 * node + 1])
        return place


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers; an item fits a bin. Equal sizes keep their order."""
    tree, bins = Tournament(len(sizes), capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        place = tree.take(sizes[item])
        if place == len(bins):
            bins.append([])
        bins[place].append(item)
    return bins


def close_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list:
    """Pour the emptiest bins into the gaps of the others, cutting pieces as needed.

    A piece is (item, first, length). At most one bin stays short of its capacity.
    """
    fill = [sum(piece[2] for piece in content) for content in bins]
    order = sorted(range(len(bins)), key=lambda b: -fill[b])
    fullest, emptiest = 0, len(order) - 1
    while fullest < emptiest:
        target, source = order[fullest], order[emptiest]
        gap = capacity - fill[target]
        if gap == 0:
            fullest += 1
        elif not bins[source]:
            emptiest -= 1
        else:
            item, first, length = bins[source].pop()
            moved = min(gap, length)
            bins[target].append((item, first + length - moved, moved))
            if moved < length:
                bins[source].append((item, first, length - moved))
            fill[target] += moved
            fill[source] -= moved
    return [content for content in bins if content]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Each document as whole sequences and a rest, with its ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut_one(doc_id: int | None, ids: bytes):
            total = len(ids) // 4
            for start in range(0, total, capacity):
                part = ids[4 * start : 4 * (start + capacity)]
                yield {
                    "doc_id": doc_id,
                    "start": start,
                    "length": len(part) // 4,
                    "doc_tokens": total,
                    "ids": part,
                }

        def rows():
            with encoding(tokenizer) as encode:
                for batch in batches:
                    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                        yield from cut_one(doc_id, encode(text.as_py()) + end)

        return batches_of(rows(), PIECES, "ids")

    return texts(docs).mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, ids binary"
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_documents: int = GROUP_DOCUMENTS,
    fill_gaps: bool = True,
) -> DataFrame:
    """(doc_id, start, doc_tokens, ids, sequence_id, offset), one row per piece.

    ``ids`` are little-endian unsigned 32-bit numbers. A null or empty text is its end
    id alone; a null doc_id is kept as null; repeated rows are packed once each; an
    empty table gives no rows; other columns are not read. With ``fill_gaps`` the
    emptiest sequences of a group are poured into the gaps of the others, so that one
    sequence of a group may be short.
    """
    groups = max(1, ceil(docs.count() / group_documents))
    group = F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(groups))
    cut = pieces(docs, tokenizer, end_id, capacity).withColumn("bin_group", group)

    def pack_group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        lengths = table["length"].to_pylist()
        bins = [[i] for i, length in enumerate(lengths) if length == capacity]
        rests = [i for i, length in enumerate(lengths) if length < capacity]
        packed = first_fit_decreasing([lengths[i] for i in rests], capacity)
        bins += [[rests[i] for i in content] for content in packed]
        placed = [[(i, 0, lengths[i]) for i in content] for content in bins]
        if fill_gaps:
            placed = close_gaps(placed, capacity)
        docs_, starts, totals, ids = (
            table[name].to_pylist() for name in ("doc_id", "start", "doc_tokens", "ids")
        )
        out = {name: [] for name in ("doc_id", "start", "doc_tokens", "ids", "sequence_id", "offset")}
        for number, content in enumerate(placed):
            offset = 0
            for item, first, length in content:
                out["doc_id"].append(docs_[item])
                out["start"].append(starts[item] + first)
                out["doc_tokens"].append(totals[item])
                out["ids"].append(ids[item][4 * first : 4 * (first + length)])
                out["sequence_id"].append((key[0].as_py() << 32) + number)
                out["offset"].append(offset)
                offset += length
        whole = pa.int64()
        return pa.table(
            {
                name: pa.array(column, pa.binary() if name == "ids" else whole)
                for name, column in out.items()
            }
        )

    return cut.groupBy("bin_group").applyInArrow(pack_group, PACKED)
