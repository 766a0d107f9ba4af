"""The Jaccard join against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from utxolens.llm import jaccard_join, queries


def plain_set(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def linked(a, b, percent=85):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def plain_components(rows, percent=85):
    sets = [plain_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j], percent):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return sorted(
        (str(doc_id), len(sets[i]), smallest.get(root(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)
    )


def components(df, **options):
    found = jaccard_join.jaccard_components(df, **options).collect()
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def family(rng, size, copies, most):
    words = [f"w{rng.randrange(10**5)}" for _ in range(size)]
    return [edited(rng, words, rng.randrange(most + 1)) for _ in range(copies)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_all_sizes(as_documents, seed):
    rng = random.Random(seed)
    texts = []
    for size in (1, 2, 4, 9, 10, 11, 14, 20, 33, 60, 100, 150, 400, 900):
        texts += family(rng, size, 8, max(1, size // 40))
    # chains: each text is near the one before only
    chain = [f"c{rng.randrange(10**5)}" for _ in range(120)]
    for i in range(0, 60, 3):
        chain = chain[:i] + [f"d{i}"] + chain[i + 1 :]
        texts.append(" ".join(chain))
    texts += ["", None, "  \n ", "One two", "one  TWO", "one two three four five", texts[5], texts[5]]
    rows = list(zip(rng.sample(range(10**4), len(texts)), texts))
    rows += [(None, texts[40]), (rows[0][0], texts[60])]
    want = plain_components(rows)
    assert components(as_documents(rows)) == want
    assert len({c for _, _, c in want}) < len(rows) * 0.7


def test_a_large_family_with_strangers(as_documents, monkeypatch):
    """Texts that share most of a template and link only partly take several rounds."""
    monkeypatch.setattr(jaccard_join, "OPEN_GROUP", 3)
    rng = random.Random(4)
    template = [f"t{i}" for i in range(90)]
    texts = [edited(rng, template, rng.choice([1, 2, 3, 4, 5, 6])) for _ in range(120)]
    rows = list(enumerate(texts))
    want = plain_components(rows)
    sizes = [sum(c == k for _, _, c in want) for k in {c for _, _, c in want}]
    assert max(sizes) > 20 and sizes.count(1) > 5
    assert components(as_documents(rows)) == want


def test_other_thresholds(as_documents):
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 40, 25, 6) + family(rng, 300, 10, 20)))
    for percent in (60, 95):
        assert components(as_documents(rows), percent=percent) == plain_components(rows, percent)


def test_tricky_documents(rows, tricky, empty):
    assert components(tricky) == plain_components(rows)
    assert components(empty) == []


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 3000), st.floats(0, 0.2), st.integers(0, 2**32), st.sampled_from([70, 85, 92]))
def test_linked_sets_share_a_signature(size, share, seed, percent):
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    kept = one[rng.random(len(one)) >= share / 2]
    more = rng.integers(0, 2**64, int(size * share / 2), dtype=np.uint64)
    other = np.unique(np.concatenate([kept, more]))
    common = len(np.intersect1d(one, other))
    if 100 * common < percent * (len(one) + len(other) - common) or common == len(one) == len(other):
        return
    assert np.intersect1d(jaccard_join.signatures(one, percent), jaccard_join.signatures(other, percent)).size


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(-3, 6), st.integers(-5, 5)), max_size=60),
    st.integers(1, 9),
    st.integers(0, 4),
)
def test_shared_signatures(rows, batch, open_group):
    rows.sort()
    kind = jaccard_join.SIGNED
    batches = [
        pa.RecordBatch.from_pylist([{"signature": s, "id": i, "own": None} for s, i in rows[k : k + batch]], schema=kind)
        for k in range(0, len(rows), batch)
    ]
    before, jaccard_join.OPEN_GROUP = jaccard_join.OPEN_GROUP, open_group
    try:
        found = [(r["signature"], r["id"]) for b in jaccard_join.shared_only(iter(batches)) for r in b.to_pylist()]
    finally:
        jaccard_join.OPEN_GROUP = before
    groups = {}
    for s, i in rows:
        groups.setdefault(s, set()).add(i)
    got = {}
    for s, i in found:
        assert i not in got.setdefault(s, set())
        got[s].add(i)
    assert all(got[s] == groups[s] for s in got)
    assert {frozenset(g) for g in got.values()} >= {frozenset(g) for g in groups.values() if len(g) > 1}
    assert all(len(g) > 1 for g in got.values())


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(1)
    for size in (1, 5, 100, 3000):
        one, other = (np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(2))
        other = np.union1d(other[: size // 3], one[size // 4 :])
        apart = len(np.setxor1d(one, other))
        differ = int(np.bitwise_count((jaccard_join.sketch_of(one) ^ jaccard_join.sketch_of(other)).view("<u8")).sum())
        assert differ <= apart and (size > 100 or differ >= 0.6 * apart)


def test_bands():
    for percent in (60, 85, 95):
        for size in [*range(1, 300), 5_000, 123_456]:
            band, top, above = jaccard_join.band_of(size, percent)
            assert size <= top and jaccard_join.band_of(top, percent)[0] == band
            assert jaccard_join.band_of(top + 1, percent)[0] == band + 1
            assert above >= size * 100 // percent


def test_the_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op13_jaccard(spark, folder)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found.collect())
    assert got == plain_components([(r.doc_id, r.text) for r in source])
