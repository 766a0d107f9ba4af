"""Token ids, files, counts and packing against the libraries and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from utxolens.llm import caches, packing, token_counts, token_files
from utxolens.llm.queries import vocabulary
from utxolens.llm.tokens import WordEncoder

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(text or "", add_special_tokens=False).ids for _, text in rows]


def test_encoder_equals_the_library(rows, ids):
    encoder = WordEncoder(PATH)
    for (_, text), want in zip(rows, ids):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def numbers(data):
    return tuple(np.frombuffer(bytes(data), "<u4").tolist())


@pytest.mark.parametrize("fill", [True, False])
def test_packing_places_every_id_once(tricky, rows, ids, fill):
    got = packing.pack(tricky, PATH, capacity=64, group_documents=25, fill_gaps=fill).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for piece in got:
        sequences[piece.sequence_id].append(piece)
        documents[piece.doc_id].append(piece)
    for content in sequences.values():
        at = 0
        for piece in sorted(content, key=lambda p: p.offset):
            assert piece.offset == at
            at += len(piece.ids) // 4
        assert at <= 64
    want = Counter((doc_id, *found, 1) for (doc_id, _), found in zip(rows, ids))
    for doc_id, content in documents.items():
        expected = [k for k in want.elements() if k[0] == doc_id]
        if len(expected) == 1:
            whole = sum((numbers(p.ids) for p in sorted(content, key=lambda p: p.start)), ())
            assert (doc_id, *whole) == expected[0]
        assert sum(len(p.ids) // 4 for p in content) == sum(len(k) - 1 for k in expected)
    filled = sum(len(p.ids) // 4 for p in got)
    if fill:
        assert len(sequences) * 64 <= filled * 1.05 + 64


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 300).tolist()
    rest, want = [], []
    for item in sorted(range(300), key=lambda i: -sizes[i]):
        place = next((b for b, r in enumerate(rest) if r >= sizes[item]), None)
        if place is None:
            rest.append(100)
            want.append([])
            place = len(rest) - 1
        rest[place] -= sizes[item]
        want[place].append(item)
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_empty_tables(empty):
    assert packing.pack(empty, PATH).count() == 0
    assert token_files.token_files(empty, PATH).count() == 0
    assert token_counts.token_counts(empty, vocabulary("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("high", [1, 2, 300, 49_408, 70_000, 2**32 - 1])
@pytest.mark.parametrize("size", [1, 255, 256, 1000])
def test_segment_round_trip(high, size):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, high, size, dtype=np.uint32)
    ids[rng.random(size) < 0.7] //= 50
    doc_ids, lengths, back = token_files.decode_segment(
        token_files.encode_segment([7, None], [size - size // 2, size // 2], ids)
    )
    assert doc_ids == [7, None] and lengths.tolist() == [size - size // 2, size // 2]
    assert (back == ids).all()


def test_token_files_keep_order_and_ids(tricky, rows, ids, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    got = token_files.token_files(tricky, PATH).select("doc_id", "start", "ids").collect()
    want = Counter((doc_id, *found, 2) for (doc_id, _), found in zip(rows, ids))
    assert Counter((r.doc_id, *numbers(r.ids)) for r in got) == want
    at = 0
    for row in sorted(got, key=lambda r: r.start):
        assert row.start == at
        at += len(row.ids) // 4
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    crc = token_files.token_files(tricky, PATH).filter("doc_id = 9").select(F.crc32("ids")).first()[0]
    assert crc == zlib.crc32(np.array([*ids[9], 2], "<u4").tobytes())


def best_split(word, scores, byte_score):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = [
            (best[start][0] + scores[word[start:end]], best[start][1] + 1)
            for start in range(end)
            if word[start:end] in scores
        ]
        if word[end - 1] not in scores:
            size = len(word[end - 1].encode())
            ways.append((best[end - 1][0] + size * byte_score, best[end - 1][1] + size))
        best.append(max(ways, key=lambda way: way[0]))
    return best[-1][1]


def test_token_counts(tricky, rows):
    path = vocabulary("piece_bpe_32k.model")
    scores, byte_score = token_counts.piece_scores(path)
    want = Counter(
        (doc_id, len((text or "").split()),
         sum(best_split(token_counts.MARK + w, scores, byte_score) for w in (text or "").split() if len(w) < 200))
        for doc_id, text in rows if not text or len(text) < 4000
    )
    got = token_counts.token_counts(tricky, path).collect()
    assert len(got) == len(rows)
    assert not want - Counter(map(tuple, got))


def test_a_full_trie_starts_again():
    scores, byte_score = token_counts.piece_scores(vocabulary("piece_bpe_32k.model"))
    small = token_counts.PrefixTrie(scores, byte_score, limit=10)
    large = token_counts.PrefixTrie(scores, byte_score)
    words = ["▁the", "▁theory", "▁them", "▁naïve", "▁日本語", "▁" + "ab" * 80]
    assert [small.count(w) for w in words] == [large.count(w) for w in words]
    assert [large.count(w) for w in words] == [best_split(w, scores, byte_score) for w in words]


def test_words_of_latin_letters_and_full_caches():
    """Words outside ASCII go to the vocabulary by their bytes; small caches change nothing."""
    from tokenizers import Tokenizer

    path = PATH
    library = Tokenizer.from_file(path)
    encoder = WordEncoder(path)
    encoder._chunks._limit = 7
    rng = random.Random(8)
    letters = "abcXYZÀÉßÿØøþÐæçñ.,;!?'`-_9 \n<|>§ªºµ´́"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want
        assert len(encoder._chunks) <= 7 and len(encoder._chunks._older) <= 7


def test_frequent_keys_outlive_a_full_cache():
    made = []
    cache = caches.TwoGenerations(lambda key: made.append(key) or key.upper(), 10, longest=4)
    for i in range(200):
        assert cache["hot"] == "HOT" and cache[f"k{i}"] == f"K{i}"
    assert made.count("hot") == 1 and len(cache) <= 10
    assert cache["longer"] == cache["longer"] == "LONGER" and made.count("longer") == 2
