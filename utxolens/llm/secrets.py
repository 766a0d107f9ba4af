"""Secrets in texts: fixed patterns, and a linear-chain conditional random field.

The field tags every token as begin, inside or outside of a secret. A token's score
depends on its own signature (keyword, shape, length, digits, variety), on those of its
neighbours and on features of the whole file; the best tag sequence of a whole text is
found by Viterbi. It is trained on windows around the pattern matches of a bounded sample
of documents, so it learns what secrets and their surroundings look like, and then tags
tokens of similar look in similar places that no pattern covers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.llm.tokens import texts

# Patterns of the three kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ADDED = "crf"
KEYWORDS = frozenset(
    "password passwd pwd secret token key apikey api_key api-key auth bearer credential"
    " credentials private access login".split()
)

SAMPLE_DOCUMENTS = 20_000  # about so many documents are looked at for training
WINDOWS_PER_DOCUMENT = 8
WINDOW = 14
ROUNDS = 120
BUCKETS = 4096
OFFSETS = (0, -1, -2, -3, -4, 1, 2)
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
TAGS = (BEGIN, INSIDE, OUTSIDE)
STRIP = 128
DECODE_TOKENS = 1 << 19

_TOKEN = re.compile(r"[\w+/-]+|[^\w\s]")
_RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")
_HEX_ONLY = re.compile(r"[0-9a-f]+")


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) by start, then kind."""
    found = []
    # The patterns start with these words; most texts have none.
    lowered = text.lower()
    if any(word in lowered for word in ("passw", "secret", "token", "api")):
        for match in ASSIGN.finditer(text):
            if match.end(2) - match.start(2) >= 6:
                found.append((match.start(), 0, match.end(), match.start(2)))
    if "AKIA" in text:
        for match in ACCESS.finditer(text):
            if match.end() - match.start() >= 20:
                found.append((match.start(), 1, match.end(), match.start()))
    for match in HEX.finditer(text):
        found.append((match.start(), 2, match.end(), match.start()))
    return [(KINDS[kind], start, end, value) for start, kind, end, value in sorted(found)]


# ------------------------------------------------------------------ features


def _length_bucket(length: int) -> int:
    return length if length < 8 else 8 + min(7, (length - 8) // 4)


def signature(token: str) -> str:
    """What the field sees of a token."""
    lowered = token.lower()
    if lowered in KEYWORDS:
        return f"k:{lowered}"
    size = _length_bucket(len(token))
    if token.isalpha():
        case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token[1:].islower() else "m"
        return f"{case}|{size}"
    if len(token) == 1:
        return f"c:{token}" if token.isascii() else "c:?"
    shape = "".join(
        "a" if run[0].islower() else "A" if run[0].isupper() else "0" if run[0].isdigit() else "-"
        for run in _RUNS.findall(token[:40])
    )
    digits = sum(letter.isdigit() for letter in token) * 4 // len(token)
    variety = len(set(token[:64])) // 4
    known = "h" if _HEX_ONLY.fullmatch(token) else ""
    changes = min(6, len(shape) // 2)
    return f"{shape[:4]}|{size}|{digits}|{variety}|{known}|{changes}"


def signature_features(seen: str, offset: int) -> list[int]:
    """Numbers of the features of a signature at a distance."""
    parts = seen.split("|")
    names = [seen]
    if len(parts) == 2:
        names += [f"case={parts[0]}", f"size={parts[1]}"]
    elif len(parts) > 2:
        names += [f"{name}={value}" for name, value in zip("fsdvhc", parts)]
        names.append(f"sd={parts[1]},{parts[2]}")
    if offset:
        names = names[: 1 if len(parts) == 1 else 2]
    return [_bucket(f"{offset}/{name}") for name in names]


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % BUCKETS


def file_features(text: str) -> list[str]:
    """Features of the whole text: digits, assignments and line length."""
    size = max(1, len(text))
    marks = text.count("=") + text.count(":")
    lines = text.count("\n") + 1
    return [
        f"file marks={min(5, int(marks * 400 / size))}",
        f"file lines={min(5, int(lines * 200 / size))}",
        f"file code={int('{' in text) + int(';' in text)}",
    ]


# ------------------------------------------------------------------ training


class Field:
    """Weights: features by tag, tag to tag, and first tag."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.weights, self.moves, self.first = weights, moves, first

    @classmethod
    def outside(cls) -> "Field":
        """The field that tags nothing, for a sample without a secret."""
        weights, moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
        moves[:, OUTSIDE] = 1.0
        return cls(weights, moves, moves[0].copy())

    def emissions(self, seen: str) -> np.ndarray:
        """(offsets, tags) scores that a token with this signature gives its neighbours."""
        return np.array(
            [self.weights[signature_features(seen, offset)].sum(axis=0) for offset in OFFSETS]
        )

    def of_file(self, names: list[str]) -> np.ndarray:
        return self.weights[[_bucket(name) for name in names]].sum(axis=0)


def train(windows: list, rounds: int = ROUNDS, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam over (signatures, tags, file features) windows."""
    if not any(tag != OUTSIDE for _, tags, _ in windows for tag in tags):
        return Field.outside()
    seen = sorted({s for signatures, _, _ in windows for s in signatures})
    number = {s: i + 1 for i, s in enumerate(seen)}
    longest, count = max(len(w[0]) for w in windows), len(windows)
    codes = np.zeros((count, longest), np.int64)
    tags = np.full((count, longest), OUTSIDE)
    real = np.zeros((count, longest))
    files = np.array([[_bucket(name) for name in names] for _, _, names in windows])
    for i, (signatures, labels, _) in enumerate(windows):
        codes[i, : len(signatures)] = [number[s] for s in signatures]
        tags[i, : len(labels)] = labels
        real[i, : len(labels)] = 1
    # features of each signature for each offset, padded with a bucket of weight zero
    lists = [[[]] + [signature_features(s, offset) for s in seen] for offset in OFFSETS]
    wide = max(len(f) for by_code in lists for f in by_code)
    features = np.full((len(OFFSETS), len(seen) + 1, wide), BUCKETS)
    for o, by_code in enumerate(lists):
        for c, f in enumerate(by_code):
            features[o, c, : len(f)] = f
    shifted = []
    for offset in OFFSETS:
        moved = np.zeros_like(codes)
        if offset < 0:
            moved[:, -offset:] = codes[:, :offset]
        elif offset > 0:
            moved[:, :-offset] = codes[:, offset:]
        else:
            moved = codes
        shifted.append(moved)
    size = BUCKETS * 3
    theta = np.zeros(size + 12)
    mean, power = np.zeros_like(theta), np.zeros_like(theta)
    hot = np.eye(3)[tags] * real[..., None]
    for step in range(1, rounds + 1):
        weights = np.vstack([theta[:size].reshape(BUCKETS, 3), np.zeros((1, 3))])
        moves, first = theta[size : size + 9].reshape(3, 3), theta[size + 9 :]
        scores = weights[files].sum(axis=1)[:, None, :].repeat(longest, axis=1)
        for o in range(len(OFFSETS)):
            scores += weights[features[o]].sum(axis=1)[shifted[o]]
        forward = np.zeros((count, longest, 3))
        forward[:, 0] = first + scores[:, 0]
        for t in range(1, longest):
            ahead = _log_sum(forward[:, t - 1, :, None] + moves, 1) + scores[:, t]
            forward[:, t] = np.where(real[:, t, None] > 0, ahead, forward[:, t - 1])
        backward = np.zeros((count, longest, 3))
        for t in range(longest - 2, -1, -1):
            behind = _log_sum(moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None] > 0, behind, 0.0)
        total = _log_sum(forward[:, -1], 1)
        chance = np.exp(forward + backward - total[:, None, None]) * real[..., None]
        error = hot - chance
        slope = np.zeros((BUCKETS + 1, 3))
        by_file = error.sum(axis=1)
        for column in files.T:
            np.add.at(slope, column, by_file)
        for o in range(len(OFFSETS)):
            flat = shifted[o].ravel()
            by_code = np.stack(
                [np.bincount(flat, error[..., k].ravel(), len(seen) + 1) for k in range(3)], axis=1
            )
            for f in range(wide):
                np.add.at(slope, features[o, :, f], by_code)
        pairs = np.zeros((3, 3))
        for t in range(1, longest):
            both = np.exp(
                forward[:, t - 1, :, None]
                + moves
                + (scores[:, t] + backward[:, t])[:, None, :]
                - total[:, None, None]
            )
            pairs += (
                hot[:, t - 1, :, None] * hot[:, t, None, :] - both * real[:, t, None, None]
            ).sum(axis=0)
        gradient = np.concatenate([slope[:BUCKETS].ravel(), pairs.ravel(), error[:, 0].sum(axis=0)])
        gradient = gradient / count - decay * theta
        mean = 0.9 * mean + 0.1 * gradient
        power = 0.99 * power + 0.01 * gradient**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (
            np.sqrt(power / (1 - 0.99**step)) + 1e-6
        )
    return Field(
        theta[:size].reshape(BUCKETS, 3), theta[size : size + 9].reshape(3, 3), theta[size + 9 :]
    )


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


# ------------------------------------------------------------------ decoding


def viterbi(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray):
    """Best tags of texts laid one after the other; ``starts`` marks their first tokens.

    The row of tokens is cut into strips that are worked through side by side: the best
    score from each tag before a strip to each tag at its end, then the strips in turn,
    then back again. The result is that of the plain recursion.
    """
    length = len(scores)
    strips = max(1, -(-length // STRIP))
    padded = np.zeros((strips * STRIP, 3), np.float32)
    padded[:length] = scores
    fresh = np.ones(strips * STRIP, np.float32)
    fresh[:length] = starts
    # one contiguous row of strips for each step and tag
    e = np.ascontiguousarray(padded.reshape(strips, STRIP, 3).transpose(1, 2, 0))
    new = np.ascontiguousarray(fresh.reshape(strips, STRIP).T)
    moves, first = moves.astype(np.float32), first.astype(np.float32)
    turn = first[None, :] - moves  # what a first token changes

    def step(t: int) -> list[list[np.ndarray]]:
        """ways[j][i]: from tag i to tag j."""
        if new[t].any():
            return [[moves[i, j] + turn[i, j] * new[t] + e[t, j] for i in TAGS] for j in TAGS]
        return [[moves[i, j] + e[t, j] for i in TAGS] for j in TAGS]

    best = [[np.full(strips, 0 if a == j else -1e9, np.float32) for j in TAGS] for a in TAGS]
    for t in range(STRIP):
        ways = step(t)
        best = [
            [
                np.maximum(
                    np.maximum(best[a][0] + ways[j][0], best[a][1] + ways[j][1]),
                    best[a][2] + ways[j][2],
                )
                for j in TAGS
            ]
            for a in TAGS
        ]
    across = np.array(best).transpose(2, 0, 1).tolist()
    entering, state = [], [0.0, 0.0, 0.0]
    for way in across:
        entering.append(state)
        state = [max(state[a] + way[a][j] for a in TAGS) for j in TAGS]
        top = max(state)
        state = [value - top for value in state]
    came = np.empty((STRIP, 3, strips), np.int8)
    current = list(np.array(entering, np.float32).T)
    for t in range(STRIP):
        ways, following = step(t), []
        for j in TAGS:
            one, two, three = (current[i] + ways[j][i] for i in TAGS)
            most = np.maximum(one, two)
            came[t, j] = np.where(three > most, 2, two > one)
            following.append(np.maximum(most, three))
        current = following
    place = np.arange(strips)
    back = [np.full(strips, j, np.int8) for j in TAGS]
    for t in range(STRIP - 1, -1, -1):
        back = [came[t][back[j], place] for j in TAGS]
    before = np.array(back).T.tolist()
    last, tag = [0] * strips, state.index(max(state))
    for s in range(strips - 1, -1, -1):
        last[s] = tag
        tag = before[s][tag]
    tags, here = np.empty((STRIP, strips), np.int8), np.array(last, np.int8)
    for t in range(STRIP - 1, -1, -1):
        tags[t] = here
        here = came[t][here, place]
    return tags.T.ravel()[:length]


class Tagger:
    """A field with the scores of the signatures met so far."""

    TOKENS_KEPT = 500_000

    def __init__(self, field: Field):
        self._field = field
        self._codes: dict[str, int] = {}
        self._signatures: dict[str, int] = {}
        self._plain: dict[tuple, int] = {}
        self._scores = np.zeros((1024, len(OFFSETS), 3), np.float32)

    def _code(self, token: str) -> int:
        """The number of the token's signature, from 1."""
        plain = token.isalpha() and (token.islower(), token[1:].islower(), len(token))
        code = plain and self._plain.get(plain)
        if not code or token.lower() in KEYWORDS:
            seen = signature(token)
            code = self._signatures.get(seen)
            if code is None:
                code = self._signatures[seen] = len(self._signatures) + 1
                if code == len(self._scores):
                    self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
                self._scores[code] = self._field.emissions(seen)
            if plain and (plain[0] or plain[1]) and not seen.startswith("k:"):
                self._plain[plain] = code
        if len(self._codes) >= self.TOKENS_KEPT:
            self._codes.clear()
        if len(token) <= 64:
            self._codes[token] = code
        return code

    def spans(self, some_texts: list[str]) -> list[list[tuple[int, int]]]:
        """Tagged spans of each text."""
        known, new, codes, lengths, files = self._codes.get, self._code, [], [], []
        for text in some_texts:
            tokens = _TOKEN.findall(text)
            lengths.append(len(tokens))
            files.append(self._field.of_file(file_features(text)))
            codes += [known(token) or new(token) for token in tokens]
        if not codes:
            return [[] for _ in some_texts]
        codes_, sizes = np.array(codes, np.int64), np.array(lengths)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        scores = np.array(files, np.float32)[text_of]
        for o, offset in enumerate(OFFSETS):
            size = len(codes_) - abs(offset)
            if size <= 0:
                continue
            to = slice(-offset, None) if offset < 0 else slice(0, size)
            of = slice(0, size) if offset <= 0 else slice(offset, None)
            inside = (text_of[to] == text_of[of])[:, None]
            scores[to] += self._scores[codes_[of], o] * inside
        starts = np.concatenate([[True], text_of[1:] != text_of[:-1]])
        tags = viterbi(scores, starts, self._field.moves, self._field.first)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        found = []
        for i, text in enumerate(some_texts):
            own = tags[firsts[i] : firsts[i + 1]]
            found.append(_tagged(text, own) if (own != OUTSIDE).any() else [])
        return found


def _tagged(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    before = OUTSIDE
    for match, tag in zip(_TOKEN.finditer(text), tags.tolist()):
        if tag == BEGIN or (tag == INSIDE and before == OUTSIDE):
            spans.append(match.span())
        elif tag == INSIDE:
            spans[-1] = (spans[-1][0], match.end())
        before = tag
    return spans


# ------------------------------------------------------------------ on tables


def training_windows(text: str, choice: int) -> list[tuple[list[str], list[int], list[str]]]:
    """Windows around the matches of a text; for one text in ten, one elsewhere."""
    spans = [(value, end) for _, _, end, value in base_spans(text)]
    if not spans and choice % 10:
        return []
    places = [match.span() for match in _TOKEN.finditer(text)]
    tags, last = [], None
    for start, end in places:
        inside = next((s for s in spans if s[0] <= start and end <= s[1]), None) if spans else None
        tags.append(OUTSIDE if inside is None else INSIDE if inside == last else BEGIN)
        last = inside
    centres = [i for i, tag in enumerate(tags) if tag == BEGIN][:WINDOWS_PER_DOCUMENT]
    if places:
        centres.append(choice % len(places))
    names = file_features(text)
    windows = []
    for centre in centres:
        low, high = max(0, centre - WINDOW), centre + WINDOW + 1
        signatures = [signature(text[a:b]) for a, b in places[low:high]]
        windows.append((signatures, tags[low:high], names))
    return windows


WINDOW_DDL = "signatures array<string>, tags array<int>, names array<string>"


def fit(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> Field:
    """A field trained on windows of about ``sample_documents`` documents.

    The sample is a digest range of (doc_id, text), so it doesn't depend on row order;
    a document gives at most ``WINDOWS_PER_DOCUMENT`` + 1 windows of 29 tokens.
    """
    share = min(1.0, sample_documents / max(1, docs.count()))
    digest = F.xxhash64("doc_id", "text")
    sample = (
        texts(docs)
        .withColumn("choice", F.pmod(digest, F.lit(1 << 20)))
        .filter(F.col("choice") < int(share * (1 << 20)))
        .withColumn("choice", F.pmod(F.hash("text"), F.lit(1 << 20)))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, choice in zip(batch["text"], batch["choice"].to_pylist()):
                rows += training_windows(text.as_py() or "", choice)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.list_(pa.string())),
                    pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                ],
                names=["signatures", "tags", "names"],
            )

    windows = sample.mapInArrow(cut, WINDOW_DDL).collect()  # bounded by the sample
    windows = sorted((list(w.signatures), list(w.tags), list(w.names)) for w in windows)
    return train([w for w in windows if w[0]])


FOUND = "doc_id long, kind array<string>, start array<long>, end array<long>"


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, kind[], start[], end[]): the spans of every whole text, in order.

    Starts and ends are code points, ends exclusive. Kinds are ``assign``, ``access`` and
    ``hex`` of the patterns and ``crf`` of spans that only the field finds; a tagged span
    that overlaps a pattern's is not repeated. A null or empty text has none; null and
    repeated doc_ids are kept row by row; other columns are not read.
    """
    field = fit(docs) if field is None else field
    kept = docs.sparkSession.sparkContext.broadcast(
        (field.weights.astype(np.float32), field.moves, field.first)
    )  # BUCKETS x 3 numbers

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(kept.value)
        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            some, ids, size = [], [], 0
            for doc_id, text in zip(doc_ids, batch["text"]):
                some.append(text.as_py() or "")
                ids.append(doc_id)
                size += len(some[-1])
                if size > 4 * DECODE_TOKENS:
                    yield _found(ids, some, tagger)
                    some, ids, size = [], [], 0
            if some:
                yield _found(ids, some, tagger)

    return texts(docs).mapInArrow(find, FOUND)


_TAGGERS: dict[bytes, Tagger] = {}


def _tagger(model: tuple) -> Tagger:
    """The tagger of this worker process; only the last model is kept."""
    weights, moves, first = model
    key = hashlib.sha256(weights.tobytes() + moves.tobytes() + first.tobytes()).digest()
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(Field(weights, moves, first))
    return _TAGGERS[key]


def _found(ids: list, some_texts: list[str], tagger: Tagger) -> pa.RecordBatch:
    kinds, starts, ends = [], [], []
    for text, tagged in zip(some_texts, tagger.spans(some_texts)):
        base = base_spans(text)
        spans = [(start, KINDS.index(kind), kind, end) for kind, start, end, _ in base]
        for start, end in tagged:
            if not any(start < b and a < end for _, a, b, _ in base):
                spans.append((start, len(KINDS), ADDED, end))
        spans.sort()
        kinds.append([s[2] for s in spans])
        starts.append([s[0] for s in spans])
        ends.append([s[3] for s in spans])
    whole = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(kinds, pa.list_(pa.string())),
            pa.array(starts, whole),
            pa.array(ends, whole),
        ],
        names=["doc_id", "kind", "start", "end"],
    )
