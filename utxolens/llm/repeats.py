"""Removal of byte strings that appear earlier in the corpus.

The repeated windows of a fixed length are the groups of equal suffixes when suffixes are
ordered by that many bytes and no further: a radix sort from the most significant digit,
cut at that depth, in which a suffix without a partner leaves after each pass.

The digits are chosen by content, so that few suffixes need a row. Every window holds the
pass-one digit, its least ``DIGIT``-byte string by hash; windows in a row with the same one
are one run. Pass one orders runs by that digit, pass two by all their bytes: a run equal
to an earlier one is repeated as a whole, and a run whose digit nobody shares has no
repeat at all. What is left are runs that share a digit but differ, at the edges of
repeats or by chance. Each is cut in two: the windows of one half all hold the digit with
so many bytes before it, those of the other with so many behind it. Pass three groups the
halves by these longer digits, and drops those that nobody shares; pass four orders the
single windows of the others by all their bytes.

Rows are ordered within a task by an external sort and read in one pass, so a frequent
digit needs time but no memory, and equal runs of a buffer travel once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.functions.hot_keys import join_back
from utxolens.sources.storage import WorkTables

LENGTH = 100
DIGIT = 24
BUFFER_BYTES = 1 << 19
TASK_RUNS = 500_000
MERGE_ROWS = 100_000
BROADCAST_PLACES = 2_000_000  # more are joined with the texts by shuffle
RUN, REPEAT, EDGE = 0, 1, 2

# Odd multipliers of two independent polynomial hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
ROWS_DDL = "h long, r long, ord long, at long, kind int"
HALVES_DDL = "left int, halves long"
NULL_ID = 1 << 62


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a buffer by running sums."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        power, inverse = self._table(base, len(data) + 1)
        self._inverse = inverse
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self._sums[1:])

    @classmethod
    def _table(cls, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        known = cls._powers.get(base)
        if known is None or len(known[0]) < size:
            size = max(size, 2 * (BUFFER_BYTES + LENGTH))
            back = pow(base, -1, 1 << 64)
            tables = []
            for factor in (base, back):
                table = np.full(size, factor, np.uint64)
                table[0] = 1
                tables.append(np.cumprod(table, dtype=np.uint64))
            known = cls._powers[base] = tables[0], tables[1]
        return known

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[ends] - self._sums[starts]) * self._inverse[starts])


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span, found = 1, values
    while 2 * span <= width:
        found = np.minimum(found[:-span], found[span:])
        span *= 2
    rest = width - span
    return np.minimum(found[: len(found) - rest], found[rest:]) if rest else found


def runs(data: np.ndarray, doc_of: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows of texts laid one after the other.

    (digit hash, hash of the whole run, first window, windows, windows of the first half,
    hashes of the longer digits of both halves, 32 bits each). ``doc_of`` numbers the text of
    each byte; no window crosses texts.
    """
    hashes, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    none = hashes, hashes, numbers, numbers, numbers, hashes
    windows = len(data) - length + 1
    if windows <= 0:
        return none
    digit = min(DIGIT, length)
    one, two = Hashes(data, _BASES[0]), Hashes(data, _BASES[1])
    places = np.arange(len(data) - digit + 1)
    digits = one.of(places, places + digit)
    # 36 bits of the hash, then the place: the leftmost of equal ones is the least
    ranked = (digits & np.uint64(0xFFFFFFFFF0000000)) | places.astype(np.uint64)
    chosen = (_least_of(ranked, length - digit + 1) & np.uint64(0x0FFFFFFF)).astype(np.int64)
    valid = doc_of[:windows] == doc_of[length - 1 :]
    new = np.ones(windows, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1]) | (doc_of[1:windows] != doc_of[: windows - 1])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], windows) - 1
    kept = valid[firsts]
    firsts, lasts = firsts[kept], lasts[kept]
    whole = two.of(firsts, lasts + length)
    at, count = chosen[firsts], lasts - firsts + 1
    shape = ((at - firsts) * 256 + (lasts - firsts)).astype(np.uint64)
    # windows that start by ``half`` or more before the digit, and the others
    half = (length - digit) // 2
    left = np.clip(at - half - firsts + 1, 0, count)
    before = two.of(np.where(left > 0, at - half, at), at + digit) >> np.uint64(32)
    behind = two.of(at, np.where(left < count, at + length - half + 1, at)) >> np.uint64(32)
    halves = (before << np.uint64(32)) | behind
    return digits[at], _mixed(whole + shape), firsts, count, left, halves


def packed_place(check: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """24 bits of the text's checksum, 32 of the start, 7 of the number of windows."""
    return (check << 39) | (start << 7) | windows


def _pieces(data: bytes, length: int, room: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of a text by the windows that start in each, so that long texts need no more room."""
    for at in range(0, max(1, len(data) - length + 1), room):
        yield at, data[at : at + room + length - 1]


def _buffers(batches: Iterator[pa.RecordBatch], length: int, room: int):
    """Lists of (ord, checksum, offset, bytes, places or None) of pieces, of bounded size."""
    kept, size = [], 0
    for batch in batches:
        listed = "places" in batch.schema.names
        for row, (number, text) in enumerate(zip(batch["ord"].to_pylist(), batch["text"])):
            data = (text.as_py() or "").encode()
            check = zlib.crc32(data) & 0xFFFFFF
            places = batch["places"][row].values.to_numpy() if listed else None
            for offset, piece in _pieces(data, length, room):
                own = None
                if listed:
                    start = (places >> 7) & 0xFFFFFFFF
                    own = places[(start >= offset) & (start < offset + room)]
                kept.append((number, check, offset, piece, own))
                size += len(piece)
                if size >= room:
                    yield sorted(kept, key=lambda piece: piece[:3])
                    kept, size = [], 0
    if kept:
        yield sorted(kept, key=lambda piece: piece[:3])


def _laid_out(pieces: list) -> tuple[np.ndarray, ...]:
    """bytes, piece of each byte, and of each piece: its start minus its offset, ord, checksum."""
    sizes = np.array([len(piece[3]) for piece in pieces], np.int64)
    data = np.frombuffer(b"".join(piece[3] for piece in pieces), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return (
        data,
        np.repeat(np.arange(len(pieces)), sizes),
        starts - np.array([piece[2] for piece in pieces], np.int64),
        np.array([piece[0] for piece in pieces], np.int64),
        np.array([piece[1] for piece in pieces], np.int64),
    )


def _rows(h, r, ord_, at, **more) -> pa.RecordBatch:
    """Rows of a buffer in order; equal ones but the first are repeats already.

    A repeat needs no partner any more, so its key is its place, which no one shares.
    """
    order = np.lexsort((at, ord_, r, h))
    h, r, ord_, at = h[order], r[order], ord_[order], at[order]
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    key = np.where(again, _mixed(at.astype(np.uint64)).view(np.int64), h)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key),
            pa.array(r),
            pa.array(ord_),
            pa.array(at),
            pa.array(np.where(again, REPEAT, RUN).astype(np.int32)),
            *[pa.array(values[order]) for values in more.values()],
        ],
        names=["h", "r", "ord", "at", "kind", *more],
    )


def _run_rows(length: int, room: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _buffers(batches, length, room):
            data, doc_of, starts, ords, checks = _laid_out(docs)
            h, r, first, windows, left, halves = runs(data, doc_of, length)
            doc = doc_of[first]
            at = packed_place(checks[doc], first - starts[doc], windows)
            yield _rows(
                h.view(np.int64),
                r.view(np.int64),
                ords[doc],
                at,
                left=left.astype(np.int32),
                halves=halves.view(np.int64),
            )

    return each


def _window_rows(length: int, room: int):
    """Single windows of the runs in ``places``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _buffers(batches, length, room):
            data, _, starts, ords, checks = _laid_out(docs)
            doc = np.repeat(np.arange(len(docs)), [len(piece[4]) for piece in docs])
            at = np.concatenate([piece[4] for piece in docs])
            start, count = (at >> 7) & 0xFFFFFFFF, at & 127
            steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            doc, start = np.repeat(doc, count), np.repeat(start, count) + steps
            place = starts[doc] + start
            h = Hashes(data, _BASES[0]).of(place, place + length)
            r = Hashes(data, _BASES[1]).of(place, place + length)
            own = packed_place(checks[doc], start, np.ones_like(start))
            yield _rows(h.view(np.int64), r.view(np.int64), ords[doc], own)

    return each


def _settle(*more: str):
    """Over rows in order of (h, r, ord, at): repeats, and firsts whose h has several r, with
    the columns ``more``."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("ord", "at", *more)
        held = None  # the first row of the last h, while only one r of it was seen
        last_h = last_r = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, r, kind = (batch[name].to_numpy() for name in ("h", "r", "kind"))
            columns = [batch[name].to_numpy() for name in names]
            same_h, same_r = np.zeros(len(h), bool), np.zeros(len(h), bool)
            same_h[1:] = h[1:] == h[:-1]
            same_r[1:] = same_h[1:] & (r[1:] == r[:-1])
            if last_h is not None:
                same_h[0] = h[0] == last_h
                same_r[0] = same_h[0] and r[0] == last_r
            plain = kind == RUN
            repeat = ~plain | same_r
            edge = plain & same_h & ~same_r  # a further r of its h
            # the first row of an h is an edge too if a further r follows
            group = np.cumsum(~same_h)
            several = np.zeros(group[-1] + 1, bool)
            several[group[edge]] = True
            edge |= plain & ~same_h & several[group]
            found = [[values[repeat], values[edge]] for values in columns]
            kinds = [np.full(repeat.sum(), REPEAT), np.full(edge.sum(), EDGE)]
            if held is not None and several[0]:
                for values, value in zip(found, held):
                    values.append(np.array([value]))
                kinds.append(np.array([EDGE]))
                held = None
            if not same_h[1:].all() or not same_h[0]:
                start = np.flatnonzero(~same_h)[-1]
                single = plain[start] and not several[group[start]]
                held = [values[start] for values in columns] if single else None
            last_h, last_r = h[-1], r[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(parts).astype(values.dtype))
                    for parts, values in zip(found, columns)
                ]
                + [pa.array(np.concatenate(kinds).astype(np.int32))],
                names=[*names, "kind"],
            )

    return settle


def shared_halves(edges: DataFrame) -> DataFrame:
    """(ord, at): the halves of runs (ord, at, h, left, halves) whose longer digit another
    run has too. Equal windows of two runs lie in halves that share it."""
    count, start = F.col("at").bitwiseAND(F.lit(127)), F.shiftright("at", 7)

    def half(number: int, digit: Column, first: Column, windows: Column) -> Column:
        place = F.shiftleft(first, 7).bitwiseOR(windows.cast("long"))
        return F.struct(
            F.xxhash64(F.lit(number), "h", digit).alias("key"), place.alias("at"), windows.alias("windows")
        )

    mask = F.lit(0xFFFFFFFF)
    both = F.array(
        half(0, F.shiftrightunsigned("halves", 32), start, F.col("left")),
        # the bits above the start, the text's checksum, stay as they are
        half(1, F.col("halves").bitwiseAND(mask), start + F.col("left"), count - F.col("left")),
    )
    cut = edges.select("ord", F.explode(both).alias("half")).select("ord", "half.*").filter("windows > 0")
    shared = cut.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return join_back(cut, shared, "key", how="left_semi").select("ord", "at")


def _merged(length: int):
    """Removed stretches of each text from its repeated windows."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        ord_, at = table["ord"].to_numpy(), table["at"].to_numpy()
        order = np.lexsort((at, ord_))
        ord_, at = ord_[order], at[order]
        check, start = at >> 39, (at >> 7) & 0xFFFFFFFF
        end = start + (at & 127) - 1 + length
        new = np.ones(len(at), bool)
        new[1:] = (ord_[1:] != ord_[:-1]) | (check[1:] != check[:-1])
        text = np.cumsum(new) - 1
        # ends so far within a text: texts are set apart by more than any end
        reach = np.maximum.accumulate(end + text * (1 << 33)) - text * (1 << 33)
        gap = new.copy()
        gap[1:] |= start[1:] > reach[:-1]
        firsts = np.flatnonzero(gap)
        lasts = np.append(firsts[1:], len(at)) - 1
        texts_ = np.flatnonzero(np.append(True, text[firsts][1:] != text[firsts][:-1]))
        offsets = pa.array(np.append(texts_, len(firsts)).astype(np.int32))
        return pa.table(
            {
                "ord": pa.array(ord_[firsts][texts_]),
                "check": pa.array(check[firsts][texts_]),
                "starts": pa.ListArray.from_arrays(offsets, pa.array(start[firsts])),
                "ends": pa.ListArray.from_arrays(offsets, pa.array(reach[lasts])),
            }
        )

    return merge


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(ord, check, starts, ends): removed stretches of the texts of ``keyed(docs)``."""
    work = WorkTables(docs.sparkSession, "repeats")
    tasks = _tasks(docs)

    def settled(rows: DataFrame, label: str, ddl: str = "", *more: str) -> DataFrame:
        ordered = rows.repartition(tasks, "h").sortWithinPartitions("h", "r", "ord", "at")
        return work.write(ordered.mapInArrow(_settle(*more), f"ord long, at long, {ddl}kind int"), label)

    run_rows = docs.select("ord", "text").mapInArrow(_run_rows(length, BUFFER_BYTES), f"{ROWS_DDL}, {HALVES_DDL}")
    found = settled(run_rows, "runs", f"h long, {HALVES_DDL}, ", "h", "left", "halves")
    edges = work.write(
        shared_halves(found.filter(F.col("kind") == EDGE))
        .groupBy("ord", F.shiftright("at", 39).alias("check"))
        .agg(F.sort_array(F.collect_set("at")).alias("places")),
        "edges",
    )
    bounded = (edges.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES
    cut = F.broadcast(edges) if bounded else edges
    held = docs.select("ord", "check", "text").join(cut, ["ord", "check"]).select("ord", "text", "places")
    single = settled(held.mapInArrow(_window_rows(length, BUFFER_BYTES), ROWS_DDL), "windows")
    repeated = (
        found.filter(F.col("kind") == REPEAT)
        .select("ord", "at")
        .unionByName(single.filter(F.col("kind") == REPEAT).select("ord", "at"))
    )
    groups = max(1, ceil(repeated.count() / MERGE_ROWS))
    spans = work.write(
        repeated.withColumn("task", F.pmod(F.xxhash64("ord"), F.lit(groups)))
        .groupBy("task")
        .applyInArrow(_merged(length), "ord long, check long, starts array<long>, ends array<long>"),
        "spans",
    )
    for table in (found, edges, single):
        work.drop(table)
    return spans


def _tasks(docs: DataFrame) -> int:
    """Tasks for about ``TASK_RUNS`` runs each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, ceil(total * 2 / (LENGTH - DIGIT) / TASK_RUNS))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, check, text). Texts without a doc_id come last, in an order of their own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.xxhash64(text).bitwiseAND(F.lit(NULL_ID - 1)).bitwiseOR(F.lit(NULL_ID))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, own).alias("ord"),
        F.crc32(text.cast("binary")).bitwiseAND(F.lit(0xFFFFFF)).alias("check"),
        text.alias("text"),
    )


KEPT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): texts without what appears earlier.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller
    doc_id, or before in the same document. Null and empty texts are empty and lose
    nothing. Documents without doc_id come after all others, in an order of their own;
    rows that repeat both doc_id and text are one document and share its result. An empty
    table gives no rows; other columns are not read.
    """
    own = keyed(docs)
    spans = removed_spans(own, length)
    bounded = (spans.agg(F.sum(F.size("starts"))).first()[0] or 0) <= BROADCAST_PLACES
    joined = own.join(F.broadcast(spans) if bounded else spans, ["ord", "check"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept")}
            for text, starts, ends in zip(
                batch["text"], batch["starts"].to_pylist(), batch["ends"].to_pylist()
            ):
                data, at, parts = text.as_py().encode(), 0, []
                for start, end in zip(starts or [], ends or []):
                    parts.append(data[at:start])
                    at = end
                kept = b"".join(parts) + data[at:]
                columns["n_bytes"].append(len(data))
                columns["n_removed"].append(len(data) - len(kept))
                columns["n_spans"].append(len(starts or []))
                columns["kept"].append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"]]
                + [pa.array(columns[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")]
                + [pa.array(columns["kept"], pa.binary())],
                names=["doc_id", *columns],
            )

    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(cut, KEPT_DDL)
