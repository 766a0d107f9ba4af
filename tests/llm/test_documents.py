"""Toxicity, near-duplicates, decontamination and repeats against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from utxolens.llm import decontaminate, repeats, simhash, toxicity


def as_table(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)


class Sets:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(tricky, rows, empty):
    prints = [(doc_id, plain_fingerprint(text)) for doc_id, text in rows]
    sets = Sets()
    for _, a in prints:
        for _, b in prints:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    least = {}
    for doc_id, value in prints:
        if doc_id is not None:
            least[sets.find(value)] = min(doc_id, least.get(sets.find(value), doc_id))
    want = Counter((d, f"{v:016x}", least.get(sets.find(v))) for d, v in prints)
    assert Counter(map(tuple, simhash.near_duplicates(tricky).collect())) == want
    kept = simhash.dedup(tricky)
    assert kept.columns == tricky.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids) - {None} == set(least.values()) and all(n == 1 for d, n in ids.items() if d is not None)
    assert simhash.near_duplicates(empty).count() == simhash.dedup(empty).count() == 0


def test_a_text_is_not_dropped_for_another_with_its_doc_id(spark, rows):
    texts = [text for _, text in rows if text and len(text.split()) > 30]
    first, second, third, fourth = list({plain_fingerprint(t): t for t in texts}.values())[:4]
    assert all((plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() > 4 for a, b in
               [(first, second), (first, third), (first, fourth), (second, third), (second, fourth), (third, fourth)])
    # one doc_id with two texts; one with a copy and a text of its own; copies without a doc_id
    odd = [(1, first), (1, second), (3, first), (3, third), (3, third), (None, fourth), (None, fourth), (None, second)]
    kept = simhash.dedup(as_table(spark, odd)).collect()
    want = [(1, first), (1, second), (3, third), (None, fourth)]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(want)


@pytest.mark.parametrize("chunk", [15, 1000])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    values = set()
    for centre in rng.integers(0, 1 << 64, 12, dtype=np.uint64).tolist():
        for _ in range(60):
            value = centre
            for bit in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                value ^= 1 << bit
            values.add(value)
    numbers = np.array(sorted(values), np.uint64)
    signed = numbers.view(np.int64).tolist()
    want, got = Sets(), Sets()
    for i, a in enumerate(signed):
        for j in np.flatnonzero(np.bitwise_count(numbers[i] ^ numbers) <= 4).tolist():
            want.join(a, signed[j])
    for link in simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect():
        assert ((link.src ^ link.dst) & (1 << 64) - 1).bit_count() <= 4
        got.join(link.src, link.dst)
    assert [got.find(v) for v in signed] == [want.find(v) for v in signed]


@pytest.mark.parametrize("bands", [5, 6, 7, 8])
def test_any_four_bits_leave_a_shared_key(spark, bands):
    rng = random.Random(bands)
    pairs = []
    for _ in range(200):
        value = rng.getrandbits(64)
        other = value
        for bit in rng.sample(range(64), 4):
            other ^= 1 << bit
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (value, other)))
    df = spark.createDataFrame(pairs, "a long, b long")
    keys = df.select(*[simhash.band_keys(df[c], bands, bands - 4).alias(c) for c in "ab"])
    assert all(set(r.a) & set(r.b) for r in keys.collect())


# ------------------------------------------------------------------ decontamination


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_leaks(rows, items):
    found = Counter()
    for item_id, item in items:
        own = plain_words(item)
        size = min(5, len(own))
        shingles = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for doc_id, text in rows:
            words = plain_words(text)
            held = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
            if shingles and len(shingles & held) >= 0.8 * len(shingles) - 1e-9:
                found[doc_id, item_id, len(shingles & held), len(shingles)] += 1
    return found


def test_leaks(spark, tricky, rows, empty):
    rng = random.Random(9)
    items = []
    for i in range(60):
        words = (rng.choice(rows)[1] or "one two three").split()[:400]
        start = rng.randrange(max(1, len(words) - 5))
        some = words[start : start + rng.choice([1, 2, 3, 4, 5, 9, 20, 40])]
        for _ in range(rng.choice([0, 0, 1, 2, 5]) if some else 0):
            some[rng.randrange(len(some))] = "changed"
        items.append((i, " ".join(some)))
    items += [(90, None), (91, ""), (92, "!!!"), (93, items[0][1]), (93, items[1][1])]
    items = items[:-1]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(tricky, table).collect()
    want = plain_leaks(rows, items)
    assert Counter((r.doc_id, r.item_id, r.matched, r.shingles) for r in got) == want
    clean = decontaminate.decontaminate(tricky, table)
    leaked = {d for d, *_ in want}
    assert clean.columns == tricky.columns
    assert {r.doc_id for r in clean.collect()} - {None} == {d for d, _ in rows} - leaked - {None}
    assert decontaminate.leaks(empty, table).count() == 0
    assert decontaminate.decontaminate(tricky, table.limit(0)).count() == len(rows)


# ------------------------------------------------------------------ repeats


def plain_repeats(rows, length):
    """(doc_id, bytes, removed, spans, kept) of documents with distinct ids."""
    seen, found = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        found[doc_id] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))
    return found


@pytest.mark.parametrize("length, buffer", [(100, 1 << 21), (100, 3000), (30, 3000)])
def test_repeats(spark, tricky, rows, monkeypatch, length, buffer):
    monkeypatch.setattr(repeats, "BUFFER_BYTES", buffer)
    monkeypatch.setattr(repeats, "TASK_RUNS", 300)
    once = {d: t for d, t in rows if d is not None}
    want = plain_repeats(once.items(), length)
    known = tricky.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(known, length).collect()}
    assert got == want


def test_repeats_of_odd_rows(tricky, empty, rows):
    got = repeats.without_repeats(tricky).collect()
    assert len(got) == len(rows)
    again = next(r for r in got if r.doc_id is None and r.n_bytes)
    assert again.n_removed == again.n_bytes  # a copy without a doc_id comes after the other
    assert repeats.without_repeats(empty).count() == 0


def test_runs_that_share_a_digit_by_chance_are_not_cut_into_windows(spark, monkeypatch):
    written = {}
    write = repeats.WorkTables.write

    def kept(self, df, label):
        table = write(self, df, label)
        if label == "edges":
            written[label] = [(r.ord, len(r.places)) for r in table.collect()]
        return table

    monkeypatch.setattr(repeats.WorkTables, "write", kept)
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = letters(60)
    texts = [(i, letters(150) + phrase + letters(150)) for i in range(30)]
    assert all(r.n_removed == 0 for r in repeats.without_repeats(as_table(spark, texts)).collect())
    assert written["edges"] == []
    texts[7] = (7, texts[7][1] + texts[3][1][20:300])
    removed = {r.doc_id: r.n_removed for r in repeats.without_repeats(as_table(spark, texts)).collect()}
    assert removed == {i: 280 if i == 7 else 0 for i in range(30)}
    assert {ord_ for ord_, _ in written["edges"]} <= {3, 7}


# ------------------------------------------------------------------ toxicity


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    plain = "river stone cloud winter garden letter music paper window bread silver road".split()
    bad = "idiot stupid scum blorgface blorgling".split()
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(plain) for _ in range(rng.randrange(15, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
            words.insert(0, "you")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(0, 1), (7, None), (None, 1), (9999, 0)]
    return as_table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), labels


def test_toxicity_on_the_held_out_fold(judged, tricky, empty, rows):
    docs, labels, known = judged
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity(docs, labels, model).collect()
    truth = dict(known[:500])
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert any(term.startswith("blor") for term in model.lexicon)
    odd = toxicity.toxicity(tricky, labels, model).collect()
    assert len(odd) == len(rows)
    empties = {r.score for r in odd if r.doc_id in (60, 61)}
    assert len(empties) == 1
    kept = toxicity.without_toxic(tricky, labels, model)
    assert kept.columns == tricky.columns
    kept = Counter(r.doc_id for r in kept.collect())
    assert 72 not in kept and kept == Counter(r.doc_id for r in odd if not r.predicted)
    clean = {d for d, toxic in truth.items() if not toxic}
    left = {r.doc_id for r in toxicity.without_toxic(docs, labels, model).collect()}
    assert len(clean & left) >= 0.95 * len(clean)
    assert toxicity.toxicity(empty, labels, model).count() == 0


def test_scores_read_no_other_column(spark, judged):
    docs, labels, _ = judged
    model = toxicity.fit(docs, labels)
    scores = defaultdict(set)
    for row in toxicity.toxicity(docs.selectExpr("doc_id + 100000 as doc_id", "text"), labels, model).collect():
        scores[row.doc_id - 100000].add(row.score)
    for row in toxicity.toxicity(docs, labels, model).collect():
        assert scores[row.doc_id] == {row.score}


def test_labels_of_one_kind_only(judged):
    docs, labels, _ = judged
    for kept, score in (("toxic = 0", 0.0), ("toxic = 1", 1.0), ("false", 0.0)):
        got = toxicity.toxicity(docs, labels.filter(kept))
        assert got.agg({"score": "min"}).first()[0] == got.agg({"score": "max"}).first()[0] == score
