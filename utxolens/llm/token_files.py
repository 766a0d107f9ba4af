"""Token ids in files of patched frame-of-reference blocks.

A file set is a Parquet folder of segments. A segment is one binary value: a header, the
ids and lengths of its documents, an index of block starts, and blocks of 256 ids. A
block stores its minimum, a bit width chosen at a percentile of its differences, the low
bits of all differences, and a list of (place, high bits) for those that need more.
Parquet carries the segments because Spark commits it as a whole on any file system: a
lost task leaves no half-written file.

Layout of a segment, all numbers little-endian::

    magic 'PFR1' | u32 documents | u64 ids | u32 blocks | u32 block size
    i64 doc_id x documents | u8 is_null x documents | u64 length x documents
    u64 block start x (blocks + 1) | u32 minimum x blocks | u8 width x blocks
    u16 exceptions x blocks | blocks
    block: packed low bits | u8 place x exceptions | u32 high bits x exceptions
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utxolens.llm.tokens import batches_of, encoding, texts
from utxolens.sources.storage import WorkTables

END_ID = 2
BLOCK = 256
PERCENTILE = 90
SEGMENT_IDS = 1 << 20
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIQII")

SEGMENTS = pa.schema(
    [
        ("shard", pa.int32()),
        ("segment", pa.int32()),
        ("shard_start", pa.int64()),
        ("n_ids", pa.int64()),
        ("payload", pa.binary()),
    ]
)
SEGMENT_DDL = "shard int, segment int, shard_start long, n_ids long, payload binary"
DOCUMENTS = pa.schema(
    [
        ("shard", pa.int32()),
        ("shard_start", pa.int64()),
        ("doc_id", pa.int64()),
        ("ids", pa.binary()),
    ]
)


_BITS_OF_16 = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits needed for each unsigned 32-bit number; 0 for 0."""
    if not len(values) or values.max() < 1 << 16:
        return _BITS_OF_16[values]
    high = values >> np.uint32(16)
    return np.where(high > 0, _BITS_OF_16[high] + 16, _BITS_OF_16[values & np.uint32(0xFFFF)]).astype(
        np.uint8
    )


def _low_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers as rows of bytes with ``width`` bits a number."""
    rows, size = len(values), 2 if width <= 16 else 4
    narrow = np.ascontiguousarray(values.astype(f"<u{size}")).view(np.uint8)
    bits = np.unpackbits(narrow.ravel(), bitorder="little").reshape(-1, 8 * size)[:, :width]
    return np.packbits(np.ascontiguousarray(bits).ravel(), bitorder="little").reshape(rows, -1)


def _from_low_bits(data: np.ndarray, width: int, block: int) -> np.ndarray:
    rows = len(data)
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(np.ascontiguousarray(data).ravel(), bitorder="little")
    whole = np.zeros((rows * block, 8 * size), np.uint8)
    whole[:, :width] = bits.reshape(-1, width)
    packed = np.packbits(whole.ravel(), bitorder="little")
    return packed.view(f"<u{size}").reshape(rows, block).astype("<u4")


def encode_segment(
    doc_ids: list, lengths: list[int], ids: np.ndarray, percentile: int = PERCENTILE
) -> bytes:
    """One segment of documents whose ids follow each other in ``ids``."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.concatenate([ids, np.repeat(ids[-1:], blocks * BLOCK - len(ids))]).astype("<u4")
    values = padded.reshape(blocks, BLOCK)
    least = values.min(axis=1) if blocks else np.zeros(0, "<u4")
    differences = values - least[:, None]
    bits = bit_lengths(differences)
    place = -(-BLOCK * percentile // 100) - 1
    widths = np.partition(bits, place, axis=1)[:, place] if blocks else np.zeros(0, np.uint8)
    outlier = bits > widths[:, None]
    counts = outlier.sum(axis=1).astype("<u2")
    packed: list[bytes] = [b""] * blocks
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        for part in np.array_split(rows, -(-len(rows) // 512)):
            for row, low in zip(part.tolist(), _low_bits(differences[part], width)):
                packed[row] = low.tobytes()
    for row in np.flatnonzero(counts).tolist():
        places = np.flatnonzero(outlier[row])
        high = differences[row, places] >> np.uint32(widths[row])
        packed[row] += places.astype(np.uint8).tobytes() + high.astype("<u4").tobytes()
    starts = np.zeros(blocks + 1, "<u8")
    np.cumsum([len(part) for part in packed], out=starts[1:])
    return b"".join(
        [
            HEAD.pack(MAGIC, len(doc_ids), len(ids), blocks, BLOCK),
            np.array([0 if doc is None else doc for doc in doc_ids], "<i8").tobytes(),
            np.array([doc is None for doc in doc_ids], np.uint8).tobytes(),
            np.array(lengths, "<u8").tobytes(),
            starts.tobytes(),
            least.astype("<u4").tobytes(),
            widths.astype(np.uint8).tobytes(),
            counts.tobytes(),
            *packed,
        ]
    )


def decode_segment(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment."""
    magic, documents, total, blocks, block = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEAD.size

    def column(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(payload, kind, count, at)
        at += found.nbytes
        return found

    doc_ids, is_null = column("<i8", documents), column("u1", documents)
    lengths, starts = column("<u8", documents), column("<u8", blocks + 1)
    least, widths, counts = column("<u4", blocks), column("u1", blocks), column("<u2", blocks)
    data = np.frombuffer(payload, np.uint8, offset=at)
    values = np.zeros((blocks, block), "<u4")
    for width in np.unique(widths).tolist():
        size = -(-block * width // 8)
        rows = np.flatnonzero(widths == width) if width else []
        for part in np.array_split(rows, -(-len(rows) // 512)) if len(rows) else []:
            picked = data[starts[part].astype(np.int64)[:, None] + np.arange(size)]
            values[part] = _from_low_bits(picked, width, block)
    for row in np.flatnonzero(counts).tolist():
        width, count = int(widths[row]), int(counts[row])
        first = int(starts[row]) + -(-block * width // 8)
        places = data[first : first + count]
        high = data[first + count : first + 5 * count].copy().view("<u4")
        values[row, places] |= high << np.uint32(width)
    values += least[:, None]
    known = [None if null else doc for doc, null in zip(doc_ids.tolist(), is_null.tolist())]
    return known, lengths, values.ravel()[:total]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID
) -> None:
    """Encode documents in ascending doc_id order (nulls first) into ``folder``.

    Range partitions are the shards. A task streams its documents and writes a segment
    whenever it has gathered ``SEGMENT_IDS`` ids, so memory does not follow the shard.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()

        def rows():
            number = before = size = 0
            doc_ids, parts = [], []
            with encoding(tokenizer) as to_ids:
                for batch in batches:
                    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                        doc_ids.append(doc_id)
                        parts.append(to_ids(text.as_py()) + end)
                        size += len(parts[-1]) // 4
                        if size >= SEGMENT_IDS:
                            yield segment(number, before, doc_ids, parts, size)
                            number, before, size = number + 1, before + size, 0
                            doc_ids, parts = [], []
            if parts:
                yield segment(number, before, doc_ids, parts, size)

        def segment(number, before, doc_ids, parts, size):
            ids = np.frombuffer(b"".join(parts), "<u4")
            lengths = [len(part) // 4 for part in parts]
            return {
                "shard": shard,
                "segment": number,
                "shard_start": before,
                "n_ids": size,
                "payload": encode_segment(doc_ids, lengths, ids),
            }

        return batches_of(rows(), SEGMENTS, "payload")

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENT_DDL).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in a folder of segments.

    A segment knows its start within its shard. Shard starts are the running total of
    shard sizes: one row per task that wrote.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for row in range(batch.num_rows):
                    start = batch["shard_start"][row].as_py()
                    doc_ids, lengths, ids = decode_segment(batch["payload"][row].as_py())
                    first = 0
                    for doc_id, length in zip(doc_ids, lengths.tolist()):
                        yield {
                            "shard": batch["shard"][row].as_py(),
                            "shard_start": start + first,
                            "doc_id": doc_id,
                            "ids": ids[first : first + length].tobytes(),
                        }
                        first += length

        return batches_of(rows(), DOCUMENTS, "ids")

    segments = spark.read.schema(SEGMENT_DDL).parquet(folder)
    across = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        segments.groupBy("shard")
        .agg(F.sum("n_ids").alias("n_ids"))
        .select("shard", F.coalesce(F.sum("n_ids").over(across), F.lit(0)).alias("before"))
    )
    return (
        segments.select("shard", "shard_start", "payload")
        .mapInArrow(decode, "shard int, shard_start long, doc_id long, ids binary")
        # one row per task that wrote
        .join(F.broadcast(shards), "shard")
        .select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "ids")
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids and read them back: (doc_id, start, ids).

    A null or empty text is its end id alone; rows with equal doc_id are ordered by
    text; an empty table gives no rows; other columns are not read.
    """
    folder = f"{WorkTables(docs.sparkSession, 'token-files').folder}/segments"
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder)
