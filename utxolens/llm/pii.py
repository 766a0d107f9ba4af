"""Personal data: fixed patterns, and spans found by weak supervision.

Regular expressions propose candidate spans, loosely. Labelers vote on each: the shape of
the span, a gazetteer of name and address words, and words of the context, for or against.
Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data. With those chances as weights, a
logistic regression is trained on features of the span and its surroundings, and decides.
DataFrame functions only: spans are arrays within a row, so nothing is shuffled but the
vote counts and a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.llm.tokens import texts
from utxolens.sources.storage import WorkTables

# Patterns of the four kinds, written so that no run of characters is
# tried from each of its places; the matches are those of the plain patterns.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"  # shorter ones are dropped in any case
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

# Loose candidates: numbers in groups, addresses spelt out, and named persons.
LOOSE = {
    "number": r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[ ./-]\(?[0-9]{2,6}\)?){1,4}(?![\w-])",
    "spelt": r"(?i)(?<![\w.%+-])[a-z0-9._%+-]{1,64}"
    r"(?: ?[(\[]at[)\]] ?[a-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]| dot |\.) ?[a-z]{2,10}){1,3}"
    r"| at [a-z0-9-]{1,63}(?: dot [a-z]{2,10}){1,3})(?![\w-])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? "
    r"[A-ZÀ-Þ][a-zß-ÿ]{1,20}(?: [A-ZÀ-Þ][a-zß-ÿ]{1,20})?\b",
}
GAZETTEER = r"(?i)\b(?:street|road|avenue|strasse|straße|rue|calle|gmail|yahoo|hotmail|outlook|mail|james|mary|john|anna|maria|peter|marie|jean|carlos|juan)\b"
FOR_CONTEXT = r"(?i)\b(?:call|phone|tel|telephone|mobile|fax|contact|e-?mail|write|reach|ssn|passport|card|iban|account|telefon|téléphone|teléfono|correo|courriel)\b"
AGAINST_CONTEXT = r"(?i)\b(?:version|page|pages|chapter|figure|table|isbn|issn|score|ratio|year|date|section|seite|kapitel)\b"
BEFORE = 40

SAMPLE_DOCUMENTS = 50_000  # about so many documents train the classifier
CANDIDATE_SAMPLE = 200_000  # and at most about so many of their candidates
EM_ROUNDS = 30
LABELERS = ("shape", "gazetteer", "context_for", "context_against", "long_number")
FEATURES = (
    "length digits groups separators parenthesis at_sign capital letters_before gazetteer"
    " for_word against_word number spelt person"
).split()


def _where(text: Column, sign: str | None, found: Column) -> Column:
    """``found`` if the text has a sign that every match has, else no spans."""
    if sign is None:
        return found
    return F.when(F.contains(text, F.lit(sign)), found).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,end:int,value:string,before:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before) of the matches, leftmost and not overlapping.

    The pieces between matches give the places, in code points, and the text before.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.filter(
        F.zip_with(
            F.split(text, pattern, -1), values, lambda gap, value: F.struct(
                F.length(gap).alias("gap"),
                value.alias("value"),
                F.substring(gap, -BEFORE, BEFORE).alias("before"),
            ),
        ),
        lambda piece: piece["value"].isNotNull(),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["gap"]
        end = start + F.length(piece["value"])
        span = F.struct(
            start.alias("start"), end.alias("end"), piece["value"].alias("value"), piece["before"].alias("before")
        )
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    return F.aggregate(pieces, none, add, lambda state: state["found"])


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _luhn(value: Column) -> Column:
    """Whether every second digit from the right, doubled, and the others sum to tens."""
    backwards = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(total: Column, place: Column) -> Column:
        digit = backwards.substr(place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 1, digit).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the four kinds, checked; ``text`` is not null."""
    return {
        "email": _where(text, "@", matches(text, EMAIL)),
        "ip": F.filter(
            matches(text, IP),
            lambda s: F.forall(F.split(s["value"], r"\."), lambda part: part.rlike(PART)),
        ),
        "card": F.filter(
            F.filter(matches(text, CARD), lambda s: _digits(s["value"]).between(13, 19)),
            lambda s: _luhn(s["value"]),
        ),
        "phone": F.filter(
            _where(text, "+", matches(text, PHONE)), lambda s: _digits(s["value"]).between(9, 15)
        ),
    }


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base`` and ``loose``: arrays of (kind, start, end, value, before).

    ``base`` is ordered by kind, then start. A loose candidate overlaps no base span.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_kind(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), *[
            s[name].alias(name) for name in ("start", "end", "value", "before")]))

    base = F.concat(*[of_kind(kind, spans) for kind, spans in base_spans(text).items()])
    loose = F.concat(
        *[of_kind(kind, matches(text, pattern)) for kind, pattern in LOOSE.items()]
    )
    both = docs.withColumn("spans", F.struct(base.alias("base"), loose.alias("loose")))
    apart = F.filter(
        F.col("spans.loose"),
        lambda c: ~F.exists(
            F.col("spans.base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
        ),
    )
    return both.select(
        *[F.col(name) for name in docs.columns], F.col("spans.base").alias("base"), apart.alias("loose")
    )


# ------------------------------------------------------------------ labelers


def votes(span: Column) -> Column:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 no opinion."""
    digits = _digits(span["value"])
    shape = (
        F.when(span["kind"] == "spelt", 1)
        .when(span["kind"] == "person", 0)
        .when(digits.between(9, 15), 1)
        .when(digits < 7, -1)
        .otherwise(0)
    )
    gazetteer = F.when(F.concat_ws(" ", span["before"], span["value"]).rlike(GAZETTEER), 1).otherwise(0)
    context = F.when(span["before"].rlike(FOR_CONTEXT), 1).otherwise(0)
    against = F.when(span["before"].rlike(AGAINST_CONTEXT), -1).otherwise(0)
    dated = span["value"].rlike(r"^(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4})$")
    number = F.when(dated | (digits > 15), -1).otherwise(0)
    return F.array(shape, gazetteer, context, against, number)


def features(span: Column) -> list[Column]:
    """Features of a candidate and its surroundings, in the order of ``FEATURES``."""
    value, before = span["value"], span["before"]

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("double")

    return [
        F.length(value) / 20.0,
        _digits(value) / 10.0,
        F.size(F.split(value, "[ ./-]")) / 4.0,
        (F.length(value) - F.length(F.regexp_replace(value, "[ ./-]", ""))) / 4.0,
        flag(F.contains(value, F.lit("("))),
        flag(value.rlike(r"(?i)\bat\b|@")),
        flag(value.rlike("[A-ZÀ-Þ]")),
        flag(before.rlike(r"[\p{L}:]\s*$")),
        flag(F.concat_ws(" ", before, value).rlike(GAZETTEER)),
        flag(before.rlike(FOR_CONTEXT)),
        flag(before.rlike(AGAINST_CONTEXT)),
        flag(span["kind"] == "number"),
        flag(span["kind"] == "spelt"),
        flag(span["kind"] == "person"),
    ]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> dict:
    """Chance of personal data for each vote pattern, by expectation-maximisation.

    Votes are independent given the truth; a labeler's reliability is its distribution
    of votes for either truth. ``patterns`` are at most 3 to the number of labelers.
    """
    chance = {votes: 1 / (1 + exp(-1.5 * sum(votes))) for votes, _ in patterns}
    for _ in range(rounds):
        truths = []
        for positive in (True, False):
            weight = {v: n * (chance[v] if positive else 1 - chance[v]) for v, n in patterns}
            total = sum(weight.values())
            tables = [
                {
                    vote: (sum(w for v, w in weight.items() if v[i] == vote) + 0.5) / (total + 1.5)
                    for vote in (-1, 0, 1)
                }
                for i in range(len(LABELERS))
            ]
            truths.append((total, tables))
        (yes, for_), (no, against) = truths
        for v, _n in patterns:
            odds = log((yes + 1) / (no + 1)) + sum(
                log(for_[i][vote] / against[i][vote]) for i, vote in enumerate(v)
            )
            chance[v] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
    return chance


@dataclass
class SpanClassifier:
    """A logistic regression over ``FEATURES``; ``None`` as weights keeps no candidate."""

    weights: list[float] | None
    intercept: float = 0.0

    def keeps(self, span: Column) -> Column:
        if self.weights is None:
            return F.lit(False)
        total = F.lit(self.intercept)
        for weight, feature in zip(self.weights, features(span)):
            total = total + F.lit(weight) * feature
        return total >= 0


def fit(spans: DataFrame, documents: int, sample_documents: int = SAMPLE_DOCUMENTS) -> SpanClassifier:
    """Votes, their reliabilities, and a classifier trained on the chances they give.

    Votes are counted on a digest range of about ``sample_documents`` documents.
    """
    share = min(1.0, sample_documents / max(1, documents))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))
    candidates = spans.filter(chosen).select(F.explode_outer("loose").alias("span"))
    work = WorkTables(spans.sparkSession, "pii")
    # alike candidates are one row each with their number
    alike = work.write(
        candidates.filter("span is not null")
        .select(votes(F.col("span")).alias("votes"), F.array(*features(F.col("span"))).alias("features"))
        .groupBy("votes", "features")
        .agg(F.count("*").alias("n")),
        "candidates",
    )
    counted = [
        (tuple(row["votes"]), row["n"])  # at most 3 ** 5 patterns
        for row in alike.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    ]
    if not counted:
        return SpanClassifier(None)
    chance = estimate(counted)
    known = F.create_map(
        *[F.lit(x) for v, p in chance.items() for x in (",".join(map(str, v)), float(p))]
    )
    weighed = alike.withColumn(
        "chance", known[F.array_join(F.transform("votes", lambda v: v.cast("string")), ",")]
    )
    both = weighed.select(
        "features", F.lit(1.0).alias("label"), (F.col("n") * F.col("chance")).alias("weight")
    ).unionByName(
        weighed.select(
            "features", F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("chance"))).alias("weight")
        )
    )
    columns = both.select(
        "label", "weight", *[F.col("features")[i].alias(name) for i, name in enumerate(FEATURES)]
    )
    rows = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(columns).coalesce(4)
    model = LogisticRegression(
        featuresCol="vector", weightCol="weight", regParam=0.01, maxIter=30
    ).fit(rows.filter("weight > 0"))
    return SpanClassifier([float(w) for w in model.coefficients], float(model.intercept))


def find_pii(docs: DataFrame, classifier: SpanClassifier | None = None) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end, value, before) of each whole text.

    Starts and ends are code points, ends exclusive; ``base`` is ordered by kind, then
    start. A null or empty text has no spans; null and repeated doc_ids are kept row by
    row; an empty table gives no rows; other columns are not read.
    """
    own = texts(docs)
    spans = with_spans(own)
    model = fit(spans, docs.count()) if classifier is None else classifier
    return spans.select("doc_id", "base", F.filter("loose", model.keeps).alias("added"))


def redact(docs: DataFrame, classifier: SpanClassifier | None = None) -> DataFrame:
    """All columns as they are, with spans in ``text`` replaced by their kind in brackets.

    ``n_chars``, if there is such a column, becomes the new length. Overlapping spans are
    one replacement, named after the first. A null text stays null.
    """
    # the row travels as one value, whatever its columns are called
    doc_id = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    rows = docs.select(
        F.struct("*").alias("row"), doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    spans = with_spans(rows)
    model = fit(spans, docs.count()) if classifier is None else classifier
    found = spans.withColumn(
        "found",
        F.array_sort(
            F.transform(
                F.concat("base", F.filter("loose", model.keeps)),
                lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
            )
        ),
    )
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def cut(state: Column, span: Column) -> Column:
        gap = F.col("text").substr(state["at"] + 1, span["start"] - state["at"])
        marked = F.concat(state["done"], gap, F.lit("["), span["kind"], F.lit("]"))
        later = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(later, marked).otherwise(state["done"]).alias("done"),
        )

    rest = F.aggregate(
        "found",
        none,
        cut,
        lambda state: F.concat(state["done"], F.col("text").substr(state["at"] + 1, F.length("text"))),
    )
    text = F.when(F.size("found") > 0, rest).otherwise(F.col("text"))
    done = found.select("row", F.col("text").alias("old"), text.alias("text"))
    columns = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        # counted in a plan step of its own: the text is not worked out twice
        changed = ~F.col("text").eqNullSafe(F.col("old"))
        columns["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(
            F.col("row")["n_chars"]
        )
    return done.select(
        *[columns.get(name, F.col("row")[name]).alias(name) for name in docs.columns]
    )
