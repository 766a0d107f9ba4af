"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utxolens.llm import (
    decontaminate,
    jaccard_join,
    neighbours,
    packing,
    pii,
    repeats,
    secrets,
    simhash,
    spelling,
    token_counts,
    token_files,
    toxicity,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the installed package of public vocabularies has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    read = token_files.token_files(
        table(spark, folder, "documents"), vocabulary("word_bpe_49k.json")
    )
    return read.select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model")
    )


def joined_spans(spans: str) -> Column:
    """kind:start:end of an array of (kind, start, end), joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


@query
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents")).select(
        "doc_id", F.arrays_zip("kind", "start", "end").alias("spans")
    )
    base = found.withColumn("base", F.filter("spans", lambda s: s["kind"] != secrets.ADDED))

    def number(kind: str):
        own = F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
        return own.alias(f"n_{kind}")

    return base.select(
        "doc_id",
        *[number(kind) for kind in secrets.KINDS],
        F.sha2(joined_spans("base"), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
    )


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def _duck_words(name: str, key: str) -> str:
    return rf"""
        SELECT {key}, list_filter(
            regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''
        ) AS w FROM {name}"""


def _duck_shingles(name: str, key: str) -> str:
    return f"""
        SELECT DISTINCT {key}, unnest(list_transform(
            range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM ({_duck_words(name, key)}) WHERE len(w) >= 5"""


ORACLE_SQL["op5_decontamination"] = f"""
    WITH d AS ({_duck_shingles("documents", "doc_id")}),
    i AS ({_duck_shingles("benchmark", "item_id")}),
    n AS (SELECT item_id, count(*) AS shingles FROM i GROUP BY item_id)
    SELECT doc_id, item_id, count(*) AS matched, any_value(shingles) AS shingles,
           count(*) / any_value(shingles) AS containment
    FROM d JOIN i USING (s) JOIN n USING (item_id)
    GROUP BY doc_id, item_id
    HAVING count(*) >= {decontaminate.THRESHOLD} * any_value(shingles) - 1e-9"""


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents")).withColumn(
        "spans", F.concat("base", "added")
    )

    def number(kind: str):
        own = F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
        return own.alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in pii.KINDS],
        F.sha2(joined_spans("base"), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
    )


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query
def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, folder, "documents"))


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


# A word's checksum depends on its document, so runs are counted by document first. Bytes of
# the letters above ASCII are 0xC3 and the code point less 64; the table has the remainders
# of the CRC-32 polynomial. One edit is a letter replaced (same text around a gap) or deleted.
ORACLE_SQL["op11_spelling"] = r"""
    WITH RECURSIVE remainders(byte, step, c) AS (
        SELECT range, 0, range FROM range(256)
        UNION ALL
        SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
        FROM remainders WHERE step < 8),
    crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM remainders WHERE step = 8),
    runs AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
              FROM documents)),
    counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
    bytes AS (
        SELECT run, n, flatten(list_transform(
            string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
            lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b
        FROM counted),
    hashed AS (
        SELECT run, n, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, b),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h
        FROM bytes, crc),
    spelt AS (
        SELECT CASE WHEN h % 97 = 0
            THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
            ELSE run END AS word, n
        FROM hashed),
    words AS MATERIALIZED (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt
        WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    gaps AS MATERIALIZED (
        SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
    pairs AS (
        SELECT x.word, y.word AS near FROM gaps x JOIN gaps y USING (i, a, z) WHERE x.word <> y.word
        UNION SELECT g.word, w.word FROM gaps g JOIN words w ON w.word = g.a || g.z
        UNION SELECT w.word, g.word FROM gaps g JOIN words w ON w.word = g.a || g.z),
    ranked AS (
        SELECT p.word, near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
               row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, near) AS place
        FROM pairs p JOIN words w ON w.word = near),
    judged AS MATERIALIZED (
        SELECT w.word, n, coalesce(n_near, 0) AS n_near,
               CASE WHEN near_n >= 2 * n THEN near END AS form,
               CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
        FROM words w LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r ON r.word = w.word),
    chain(word, here) AS (
        SELECT word, word FROM judged
        UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.here WHERE j.form IS NOT NULL),
    roots AS (SELECT c.word, c.here AS root FROM chain c JOIN judged j ON j.word = c.here WHERE j.form IS NULL)
    SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
    FROM judged JOIN roots USING (word)"""

# Documents with equal sets are linked with one of them; pairs are counted between the rest.
ORACLE_SQL["op13_jaccard"] = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(
            regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    shingles AS MATERIALIZED (
        SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(w) = 0 THEN []
            WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
        FROM words),
    sized AS (
        SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS content FROM shingles GROUP BY doc_id),
    firsts AS MATERIALIZED (
        SELECT doc_id, n, min(doc_id) OVER (PARTITION BY content) AS first FROM sized),
    own AS MATERIALIZED (SELECT doc_id, s, n FROM shingles JOIN firsts USING (doc_id) WHERE doc_id = first),
    pairs AS (
        SELECT x.doc_id AS a, y.doc_id AS b
        FROM own x JOIN own y ON x.s = y.s AND x.doc_id < y.doc_id
        WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
        GROUP BY a, b, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
    links AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reached(doc_id, here) AS (
        SELECT DISTINCT first, first FROM firsts
        UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.here),
    smallest AS (SELECT doc_id AS first, min(here) AS component_id FROM reached GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
           CAST(coalesce(component_id, d.doc_id) AS BIGINT) AS component_id
    FROM documents d LEFT JOIN firsts f ON f.doc_id = d.doc_id LEFT JOIN smallest USING (first)"""
