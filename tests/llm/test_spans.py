"""Secrets and personal data: base spans against plain patterns, and the trained parts."""

import re
from collections import Counter

import numpy as np
import pytest

from utxolens.llm import pii, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for place, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def personal(text):
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    spans += [
        ("card", *m.span()) for m in CARD.finditer(text)
        if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))
    ]
    return spans + [
        ("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15
    ]


def secret(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [(secrets.KINDS[kind], start, end) for start, kind, end in sorted(spans)]


@pytest.fixture(scope="module")
def mixed(spark, rows):
    """Random mixtures of the characters that the patterns are made of."""
    rng = np.random.default_rng(11)
    parts = ["a.b", "@", "x-y.com", ".", "1", "22", "255", "256", " ", "-", "+", "(", ")", "4111111111111111",
             "555 123", "é", "token", "=", '"', "ApiKey", ": ", "AKIA", "ABCDEFGH", "deadbeef", "0123", "ſecret=abcdefg"]
    made = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(400)]
    return [*rows, *enumerate(made, 1000)]


def as_table(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)


def test_base_personal_data(spark, mixed):
    got = pii.find_pii(as_table(spark, mixed), pii.SpanClassifier(None)).collect()
    want = Counter((doc_id, tuple(personal(text or ""))) for doc_id, text in mixed)
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base)) for r in got) == want


def test_base_secrets(spark, mixed):
    got = secrets.find_secrets(as_table(spark, mixed), secrets.Field.outside()).collect()
    want = Counter((doc_id, tuple(secret(text or ""))) for doc_id, text in mixed)
    assert Counter((r.doc_id, tuple(zip(r.kind, r.start, r.end))) for r in got) == want


def test_trained_parts_add_and_never_take(tricky, empty, rows):
    found = secrets.find_secrets(tricky).collect()
    assert len(found) == len(rows)
    for row in found:
        kept = [s for s in zip(row.kind, row.start, row.end) if s[0] != secrets.ADDED]
        assert kept == secret(next(t for d, t in rows if d == row.doc_id) or "") or row.doc_id is None
    assert len(pii.find_pii(tricky).collect()) == len(rows)
    assert secrets.find_secrets(empty).count() == pii.find_pii(empty).count() == 0


def test_viterbi_equals_the_plain_recursion():
    rng = np.random.default_rng(5)
    for size in (1, 2, 127, 128, 129, 700):
        scores = rng.normal(size=(size, 3)).astype(np.float32)
        starts = rng.random(size) < 0.05
        starts[0] = True
        moves, first = rng.normal(size=(3, 3)), rng.normal(size=3)
        want, bounds = [], [*np.flatnonzero(starts), size]
        for low, high in zip(bounds, bounds[1:]):
            state, came = first + scores[low], []
            for t in range(low + 1, high):
                ways = state[:, None] + moves
                came.append(ways.argmax(axis=0))
                state = ways.max(axis=0) + scores[t]
            tags = [int(state.argmax())]
            for step in reversed(came):
                tags.append(int(step[tags[-1]]))
            want += tags[::-1]
        assert secrets.viterbi(scores, starts, moves, first).tolist() == want


def test_the_field_finds_what_patterns_miss():
    rng = np.random.default_rng(1)
    filler = "the quick brown fox jumps over a lazy dog near some quiet river bank".split()

    def text(key):
        words = rng.choice(filler, 40).tolist()
        value = "".join(rng.choice(list("0123456789abcdef"), 40))
        return " ".join(words[:20]) + f' {key} = "{value}" ' + " ".join(words[20:]), value

    windows = []
    for i in range(120):
        windows += secrets.training_windows(text("token")[0], i)
    tagger = secrets.Tagger(secrets.train(windows))
    held, value = text("token")
    upper = held.replace(value, value.upper())  # neither hex nor another kind without its key
    changed = upper.replace("token =", "token is")
    assert not secret(changed)
    (spans,) = tagger.spans([changed])
    assert [changed[a:b] for a, b in spans] == [value.upper()]
    assert tagger.spans([" ".join(filler * 5), ""]) == [[], []]


def test_expectation_maximisation_separates():
    rng = np.random.default_rng(4)
    counts = Counter()
    for _ in range(5000):
        truth = rng.random() < 0.3
        right = [rng.random() < p for p in (0.95, 0.6, 0.8, 0.7, 0.9)]
        votes = [(1 if truth else -1) if ok else 0 for ok in right]
        counts[tuple(votes)] += 1
    chance = pii.estimate(sorted(counts.items()))
    assert chance[1, 0, 1, 0, 1] > 0.9 and chance[-1, 0, -1, 0, -1] < 0.1


def test_classifier_adds_spelt_addresses(spark):
    texts = [f"write to user{i} (at) example (dot) com or call 555 123 {1000 + i}" for i in range(40)]
    texts += [f"version 1.2 page 12-3{i} of 2024-01-02" for i in range(40)]
    found = pii.find_pii(as_table(spark, list(enumerate(texts)))).collect()
    added = [[s.value for s in r.added] for r in sorted(found, key=lambda r: r.doc_id)]
    assert all(any("(at)" in value for value in spans) for spans in added[:40])
    assert not any(spans for spans in added[40:])


def test_redaction(tricky, empty, rows):
    done = pii.redact(tricky, pii.SpanClassifier(None))
    assert done.columns == tricky.columns
    texts = {r.doc_id: r for r in done.collect()}
    assert texts[68].text == "mail [email], [phone]; [card] at [ip] 999.1.1.1"
    assert texts[68].n_chars == len(texts[68].text)
    assert texts[60].text is None and texts[61].text == "" and texts[2].text == rows[2][1]
    assert pii.redact(empty).count() == 0
