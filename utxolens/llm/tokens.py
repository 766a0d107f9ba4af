"""Token ids of whole texts, by a tokenizer file that every executor has installed."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.llm.caches import TwoGenerations

CHUNKS_KEPT = 300_000

# Latin letters without marks of their own, then ASCII signs other than the apostrophe.
# Such a chunk is two pre-tokens at most, and lower-casing maps each letter to one letter.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: the byte's own
    Latin-1 one if that can be printed, else one of those from U+0100 on, in order."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(0x100) if byte not in printed]
    return {byte: chr(byte) for byte in printed} | {byte: chr(0x100 + i) for i, byte in enumerate(others)}


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit numbers.

    For a tokenizer that drops white space and never looks across it: the ids of a
    text are those of its space-separated chunks, one after the other. Most chunks
    repeat, so the library is asked once per lower-cased word, as a chunk of its own, and
    the answers are kept, up to a fixed number; what is asked for again stays. A word of
    Latin letters is one pre-token, so the vocabulary is asked for its bytes directly. A
    chunk that is not a plain word with signs behind it goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        self._tokenizer = _tokenizer(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._chunks = TwoGenerations(self._chunk, CHUNKS_KEPT)

    def _whole(self, text: str) -> bytes:
        return pack_ids(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, text: str) -> bytes:
        """Ids of a lower-cased word of Latin letters."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self._letters)
        return pack_ids([token.id for token in self._model.tokenize(text)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.islower() and chunk.isalpha():
            return self._word(chunk)
        plain = _PLAIN.fullmatch(chunk)
        if plain is None or not plain[1]:
            return self._whole(chunk)
        letters, signs = plain.groups()
        word = letters.lower()
        if signs:
            return self._chunks[word] + self._chunks[signs]
        return self._word(word) if word == chunk else self._chunks[word]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self._chunks.__getitem__, text.replace("\n", " ").split(" ")))


    def forget(self) -> None:
        """Give up everything kept."""
        self._chunks.forget()


def pack_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@cache
def _tokenizer(path: str):
    """The tokenizer of this worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@contextmanager
def encoding(path: str):
    """The ``encode`` function of an encoder whose kept ids go with the task that uses it,
    so that an idle worker doesn't hold them. A task finds nearly all of them itself."""
    encoder = WordEncoder(path)
    try:
        yield encoder.encode
    finally:
        encoder.forget()


def batches_of(rows: Iterator[dict], schema: pa.Schema, nbytes: str, limit: int = 8 << 20):
    """Record batches of rows, cut when the binary column ``nbytes`` has ``limit`` bytes."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row[nbytes]) + 64
        if size >= limit:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, whatever else they have."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
