"""Token counts of documents under a unigram model, with a trie shared by pre-tokens.

The best split of a word into pieces has the largest sum of log-probabilities. Its
forward score at each prefix depends on that prefix alone, so prefixes are nodes of a
trie, scored once, and a word that ends at a node finds its count there.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from utxolens.llm.tokens import texts

MARK = "▁"
NODES_KEPT = 400_000
WORDS_KEPT = 300_000

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def piece_scores(path: str) -> tuple[dict[str, float], float]:
    """Log-probabilities of the pieces of a vocabulary file, and of a byte.

    The vocabulary is in order of frequency and has no probabilities, so piece number r
    gets the Zipf weight 1 / r. Control pieces and bytes are no pieces of a text. A
    character without a piece of its own can be its bytes, each with the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    total = log(sum(1 / rank for rank in range(1, len(names) + 2)))
    scores = {name: -log(rank) - total for rank, name in enumerate(names, 1)}
    return scores, -log(len(names) + 1) - total


class PrefixTrie:
    """Forward scores and token counts of all prefixes seen so far.

    Among splits with equal scores the one with the longest last piece counts.
    """

    def __init__(self, scores: dict[str, float], byte_score: float, limit: int = NODES_KEPT):
        self._scores, self._byte, self._limit = scores, byte_score, limit
        self._longest = max(map(len, scores), default=1)
        self._counts: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self._next: dict[tuple[int, str], int] = {}
        self._score, self._tokens = [0.0], [0]

    def count(self, word: str) -> int:
        found = self._counts.get(word)
        if found is not None:
            return found
        if len(self._score) >= self._limit:
            self._clear()
        node, path = 0, [0]
        for end, letter in enumerate(word, 1):
            step = self._next.get((node, letter))
            if step is None:
                step = self._grow(node, letter, word, end, path)
            node = step
            path.append(node)
        found = self._tokens[node]
        if len(self._counts) >= WORDS_KEPT:
            self._counts.clear()
        if len(word) <= 64:
            self._counts[word] = found
        return found

    def _grow(self, node: int, letter: str, word: str, end: int, path: list[int]) -> int:
        scores, best, tokens = self._scores, None, 0
        for begin in range(max(0, end - self._longest), end):
            piece = scores.get(word[begin:end])
            if piece is not None:
                before = path[begin]
                score = self._score[before] + piece
                if best is None or score > best:
                    best, tokens = score, self._tokens[before] + 1
        if letter not in scores:
            size = len(letter.encode())
            score = self._score[node] + size * self._byte
            if best is None or score > best:
                best, tokens = score, self._tokens[node] + size
        step = len(self._score)
        self._score.append(best)
        self._tokens.append(tokens)
        if len(path) <= 64:
            self._next[node, letter] = step
        return step


_TRIES: dict[str, PrefixTrie] = {}


def _trie(path: str) -> PrefixTrie:
    if path not in _TRIES:
        _TRIES[path] = PrefixTrie(*piece_scores(path))
    return _TRIES[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every whole text.

    Words are what white space separates, each with a mark in front. A null or empty
    text has no words; a null doc_id is kept; repeated rows are counted once each.
    Every worker grows a trie of its own, of bounded size, over all tasks it runs, so
    nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(vocabulary)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch["text"]:
                words = (text.as_py() or "").split()
                n_words.append(len(words))
                n_tokens.append(sum([trie.count(MARK + word) for word in words]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                schema=COUNTS,
            )

    return texts(docs).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
