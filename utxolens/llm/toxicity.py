"""Toxicity scores: gradient-boosted trees over dense features, calibrated.

Features of a whole text: densities of a seed lexicon and of one learned from labelled
rows, how near its words are to the second person, capitals, punctuation, and words
written with signs or digits in place of letters. Boosted trees are fitted on one part of
a bounded sample of labelled rows and an isotonic curve on another part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.llm.tokens import texts
from utxolens.sources.storage import WorkTables

# Common insults, second persons, and letters that signs stand for.
SEED = frozenset(
    "idiot stupid moron loser scum trash pathetic worthless disgusting clown dumb fool jerk"
    " imbecile garbage filth vermin hate ugly".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine tu te toi vous votre ton ta usted"
    " vosotros tus".split()
)
STANDS_FOR = str.maketrans("013457@$!", "oieastasi")

FOLDS = 5
LABELLED_ROWS = 20_000  # about so many labelled rows are learned from
LEXICON_SIZE = 2_000
LEXICON_SHARE = 0.003  # of toxic rows that must hold a term
LEXICON_ODDS = 2.0
NEAR = 6
TREES, DEPTH = 20, 3
BROADCAST_TERMS = 500_000
PREFIXES = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][\w@$*!]*[\d@$*!_][\w@$*!]*[^\W\d_]|[\d@$][\w@$]*[^\W\d_]{2}[\w@$]*")
NAMES = (
    "learned_density learned_most learned_hits learned_distinct seed_density near_second"
    " second_density capitals capital_words exclaims punctuation mixed_words uncovered length"
).split()


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class Lexicon:
    """Weights of words by themselves or by a prefix (``stem*``)."""

    KEPT = 500_000

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self._known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self._known.get(word)
        if found is None:
            terms = self.terms
            found = terms.get(word, 0.0)
            for size in PREFIXES:
                if len(word) >= size:
                    found = max(found, terms.get(word[:size] + "*", 0.0))
            if len(self._known) >= self.KEPT:
                self._known.clear()
            if len(word) <= 40:
                self._known[word] = found
        return found


def text_features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one text, in the order of ``NAMES``."""
    lowered = text.lower()
    words = _WORD.findall(lowered)
    count, size = max(1, len(words)), max(1, len(text))
    weight = lexicon.weight
    weights = [weight(word) for word in words]
    hits = [i for i, value in enumerate(weights) if value]
    seeds = second = 0
    persons = []
    for i, word in enumerate(words):
        if word in SEED:
            seeds += 1
        elif word in SECOND_PERSON:
            persons.append(i)
            second += 1
    near, at = 0, 0
    for i in hits:
        while at < len(persons) and persons[at] < i - NEAR:
            at += 1
        near += at < len(persons) and persons[at] <= i + NEAR
    original = _WORD.findall(text) if text != lowered else words
    shouted = sum(1 for word in original if len(word) > 2 and word.isupper())
    capitals = sum(1 for a in text if a.isupper()) if text != lowered else 0
    exclaims = text.count("!") + text.count("?")
    marks = exclaims + sum(text.count(mark) for mark in ".,;:*#$%&@'\"")
    mixed = _MIXED.findall(lowered)
    uncovered = 0
    for word in mixed:
        plain = word.translate(STANDS_FOR).replace("*", "").replace("_", "")
        uncovered += plain in SEED or weight(plain) > 0
    return [
        sum(weights) / count,
        max(weights, default=0.0),
        log1p(len(hits)),
        log1p(len({words[i] for i in hits})),
        seeds / count,
        near / count,
        second / count,
        capitals / size,
        shouted / count,
        exclaims / size,
        marks / size,
        len(mixed) / count,
        log1p(uncovered),
        log1p(len(words)),
    ]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, text, toxic, part) of about ``rows`` labelled rows outside the held-out fold.

    The sample is a digest range of doc_id, taken on both sides before they meet. A
    document with several labels counts as toxic if one says so. Part 0 calibrates.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(fold(F.col("doc_id")) != 0)
    )
    share = min(1.0, rows / max(1, known.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    one = known.filter(chosen).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4))
    return texts(docs).filter(chosen).join(one, "doc_id").withColumn("part", part)


def terms_of(text: Column) -> Column:
    """Distinct words of a text and their prefixes."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    long = F.filter(words, lambda w: F.length(w) >= PREFIXES[0])
    stems = [
        F.transform(
            F.filter(long, lambda w, size=size: F.length(w) >= size),
            lambda w, size=size: F.concat(F.substring(w, 1, size), F.lit("*")),
        )
        for size in PREFIXES
    ]
    return F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) >= 3), *stems))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms that toxic rows hold far more often: term -> log of the ratio of their shares.

    Terms are first counted in toxic rows, then those frequent there in the others.
    """
    fitted = sample.filter("part != 0")
    sizes = {r["toxic"]: r["n"] for r in fitted.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    work = WorkTables(sample.sparkSession, "toxicity")

    def counted(label: int) -> DataFrame:
        return fitted.filter(F.col("toxic") == label).select(F.explode(terms_of("text")).alias("term"))

    frequent = work.write(
        counted(1)
        .groupBy("term")
        .agg(F.count("*").alias("toxic"))
        .filter(F.col("toxic") >= max(3, int(LEXICON_SHARE * toxic))),
        "frequent",
    )
    small = frequent.count() <= BROADCAST_TERMS
    terms = F.broadcast(frequent) if small else frequent
    elsewhere = counted(0).join(terms.select("term"), "term").groupBy("term").agg(F.count("*").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log(
        (F.coalesce("clean", F.lit(0)) + 0.5) / (clean + 1)
    )
    best = (
        frequent.join(elsewhere, "term", "left")
        .select("term", odds.alias("odds"), "toxic")
        .filter(F.col("odds") >= LEXICON_ODDS)
        .orderBy(F.desc("odds"), F.desc("toxic"), "term")
        .limit(LEXICON_SIZE)
    )
    return {r["term"]: r["odds"] for r in best.collect()}  # at most LEXICON_SIZE


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``features`` in place of ``text``; other columns stay."""
    kept = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON_SIZE terms
    carried = [field for field in docs.schema.fields if field.name != "text"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(kept.value)
        for batch in batches:
            rows = [text_features(text.as_py() or "", own) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch[f.name] for f in carried] + [pa.array(rows, pa.list_(pa.float64()))],
                names=[f.name for f in carried] + ["features"],
            )

    return docs.mapInArrow(featurise, f"{ddl}, features array<double>")


@dataclass
class ToxicityModel:
    """A lexicon, trees over its features, and a curve over their probabilities.

    ``constant`` is the score of every text if the labels were all alike.
    """

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    constant: float

    def _raw(self, features: DataFrame) -> DataFrame:
        found = self.trees.transform(features.withColumn("features", array_to_vector("features")))
        return found.withColumn("raw", vector_to_array("probability")[1]).drop(
            "features", "probability", "rawPrediction", "prediction"
        )

    def score(self, docs: DataFrame) -> DataFrame:
        """The columns of ``docs`` other than text, and ``score``."""
        if self.trees is None:
            return docs.drop("text").withColumn("score", F.lit(self.constant))
        scored = self._raw(with_features(docs, self.lexicon))
        if self.curve is None:
            return scored.withColumnRenamed("raw", "score")
        return self.curve.transform(scored).drop("raw")


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> ToxicityModel:
    """Learn from labelled rows whose fold is not the held-out one."""
    work = WorkTables(docs.sparkSession, "toxicity-sample")
    sample = work.write(labelled_sample(docs, labels, rows), "labelled")
    lexicon = learn_lexicon(sample)
    features = work.write(
        with_features(sample.select("text", F.col("toxic").cast("double").alias("toxic"), "part"), lexicon),
        "features",
    )
    classes = {
        (r["own"], r["toxic"]): r["n"]
        for r in features.groupBy((F.col("part") != 0).alias("own"), "toxic")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    own = [classes.get((True, label), 0) for label in (0.0, 1.0)]
    if not all(own):
        return ToxicityModel(lexicon, None, None, 1.0 if own[1] else 0.0)
    trees = GBTClassifier(
        labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64
    ).fit(
        features.filter("part != 0").withColumn("features", array_to_vector("features")).coalesce(4)
    )
    model = ToxicityModel(lexicon, trees, None, 0.0)
    if all(classes.get((False, label), 0) for label in (0.0, 1.0)):
        held = model._raw(features.filter("part = 0"))
        model.curve = IsotonicRegression(
            featuresCol="raw", labelCol="toxic", predictionCol="score"
        ).fit(held.coalesce(4))
    return model


def without_toxic(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are."""
    model = fit(docs, labels) if model is None else model
    # the row travels as one value, whatever its columns are called
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return model.score(rows).filter(F.col("score") < 0.5).select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Null and empty texts get the score of a text without words. Rows with a null or
    repeated doc_id are scored one by one; a null doc_id is not held out. With no labels,
    or labels of one kind only, every score is that kind's. Other columns are not read.
    """
    model = fit(docs, labels) if model is None else model
    return model.score(texts(docs)).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"),
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
