"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from utxolens.llm import queries, spelling


def plain_words(rows, rate=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % rate == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(rows, least_length=5, least_count=3, rate=97):
    n = {w: c for w, c in plain_words(rows, rate).items() if len(w) >= least_length and c >= least_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    found = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return found


def groups(df, **settings):
    rows = spelling.spelling_groups(df, **settings).collect()
    found = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_words(as_documents, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    words += ["".join(rng.choice("AbcdefghÀ") for _ in range(rng.randrange(4, 12))) for _ in range(60)]
    for word in list(words):
        k = rng.randrange(len(word))
        words += [word[:k] + word[k + 1 :], word[:k] + rng.choice("abé") + word[k:], word[:k] + "z" + word[k + 1 :]]
    rows = [(i, " ".join(rng.choices(words, k=40, weights=[1 + (j * 7) % 5 for j in range(len(words))]))) for i in range(60)]
    df = as_documents(rows)
    for settings in ({}, {"least_length": 1, "least_count": 1, "rate": 5}):
        want = plain_groups(rows, **settings)
        assert groups(df, **settings) == want
        assert sum(row[4] for row in want) > 20 and any(row[1] for row in want)


def test_tricky_documents(rows, tricky):
    want = plain_groups(rows)
    assert groups(tricky) == want and want


def test_long_words_runs_and_chains(as_documents):
    base = "x" * 3000
    variants = [base, base[:-1], base[:1500] + "y" + base[1501:], "y" + base[1:], base[:-1] + "y", base + "x"]
    runs = ["a" * k for k in range(1, 12)] + ["aabbaab", "abbaab", "aabaab", "aabbab", "aabbaa"]
    counts = {w: 3 * 2**k for k, w in enumerate(runs[4:11])}
    text = " ".join(w for w in variants + runs for _ in range(counts.get(w, 3)))
    rows = [(7, text), (8, None), (9, ""), (9, "12 ... --")]
    want = plain_groups(rows, rate=10**10)
    assert groups(as_documents(rows), rate=10**10) == want
    assert any(r[0] == "a" * 5 and r[2] == "a" * 11 for r in want)


def test_empty_tables(spark, empty):
    assert groups(empty) == set()
    assert groups(spark.createDataFrame([(1, "no long word her")], "doc_id long, text string")) == set()
    alone = [(1, "alone Alone ALONE")]
    assert groups(spark.createDataFrame(alone, "doc_id long, text string")) == plain_groups(alone)


def test_the_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = plain_groups([(r.doc_id, r.text) for r in source])
    found = queries.op11_spelling(spark, folder)
    assert dict(found.dtypes) == {
        "word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint",
    }
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()} == want


