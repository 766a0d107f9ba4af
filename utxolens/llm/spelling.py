"""Spelling variants: words at an edit distance of one, found by a frontier in a trie.

The words of a corpus form a trie that is kept as an edge table. A frontier of states (word,
position, node, edits) is joined with it level by level: a state without edits spawns states
with one edit at the nodes of its own word, and a state with one edit follows the edge that
its word's next letter names. Where a word ends on a terminal node, word and terminal are
neighbours.

- There are two tries, of the words and of the reversed words. An edit in the second half of
  a word is made in the first trie, one in the first half in the second trie. A frontier
  thus starts in the middle of its word, where a word's own prefix is the node and few
  edges lead on, and no state is spent on the crowded levels near the root.
- The relation is symmetric, so only deletions and replacements by a later letter are made;
  of a run of equal letters the last one is deleted. Each pair of words is then found from
  one side, and both directions are returned.
- An edge knows the lengths of the words it leads to; a state goes along only if the length
  it needs is among them.
- Paths without a fork are one edge with a label. Edits are made at forks only: elsewhere
  the one way on is the word's own. A level thus is a fork, and the number of rounds doesn't
  follow the length of words.

Nodes are 128-bit digests of prefixes, labels are compared as text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.functions.hot_keys import join_back
from utxolens.llm.tokens import texts
from utxolens.sources.storage import WorkTables

LEAST_LENGTH = 5
LEAST_COUNT = 3
MISSPELT = 97
DOMINANCE = 2
COUNTS_KEPT = 100_000
LETTERS_KEPT = 8 << 20
ROWS_OUT = 20_000

# Lower-cased already: U+00C0 to U+00FF count as letters, whatever they are.
_RUN = re.compile("[a-zÀ-ÿ]+")
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
PLACES = pa.schema(
    [
        ("word_id", pa.int64()),
        ("back", pa.bool_()),
        ("place", pa.int32()),
        ("node", pa.binary()),
        ("letter", pa.string()),
    ]
)


# ---------------------------------------------------------------- words


def words_of(doc_id: int | None, text: str | None, rate: int = MISSPELT) -> Counter:
    """Words of a text with how often each occurs.

    Only A-Z are lower-cased. A run of letters whose checksum with its document is a
    multiple of ``rate`` loses the letter that the checksum points at. A document without
    a doc_id has the empty text for it.
    """
    if not text:
        return Counter()
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    runs = Counter(_RUN.findall(lowered))
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, count in runs.items():
        checksum = crc32(run.encode(), start)
        if checksum % rate == 0:
            gap = checksum % len(run)
            run = run[:gap] + run[gap + 1 :]
        found[run] += count
    return found


def word_counts(docs: DataFrame, rate: int = MISSPELT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of the words with ``least_length`` code points or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        letters = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for word, count in words_of(doc_id.as_py(), text.as_py(), rate).items():
                    if len(word) >= least_length:
                        if word not in kept:
                            letters += len(word)
                        kept[word] += count
                if len(kept) >= COUNTS_KEPT or letters >= LETTERS_KEPT:
                    yield from _counted(kept)
                    kept, letters = Counter(), 0
        yield from _counted(kept)

    return (
        texts(docs)
        .mapInArrow(each, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def _counted(kept: Counter) -> Iterator[pa.RecordBatch]:
    words = list(kept)
    for start in range(0, len(words), ROWS_OUT):
        part = words[start : start + ROWS_OUT]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), pa.array([kept[word] for word in part], pa.int64())],
            schema=COUNTS,
        )


# ---------------------------------------------------------------- trie


def middle(length: Column, back: Column) -> Column:
    """From where on a word's edits are made: the middle, rounded up in the reversed trie."""
    half = F.floor(length / 2).cast("int")
    return F.when(back, length - half).otherwise(half)


def places(words: DataFrame) -> DataFrame:
    """(word_id, back, place, node, letter): the nodes of each word from its middle on, in
    both tries, with the letter that follows (empty at the word's end)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for word_id, word in zip(batch["word_id"].to_pylist(), batch["word"].to_pylist()):
                half = len(word) // 2
                for back in (False, True):
                    own = word[::-1] if back else word
                    start = len(own) - half if back else half
                    digest = blake2b(b"<" if back else b">", digest_size=16)
                    digest.update(own[:start].encode())
                    for place in range(start, len(own) + 1):
                        letter = own[place : place + 1]
                        rows.append((word_id, back, place, digest.copy().digest(), letter))
                        digest.update(letter.encode())
                        if len(rows) >= ROWS_OUT:
                            yield _columns(rows, PLACES)
                            rows = []
        if rows:
            yield _columns(rows, PLACES)

    return words.select("word_id", "word").mapInArrow(
        each, "word_id long, back boolean, place int, node binary, letter string"
    )


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def forks(steps: DataFrame) -> DataFrame:
    """(node) with more than one way on; the end of a word is a way."""
    ways = steps.select("node", "letter").distinct()
    return ways.groupBy("node").agg(F.count("*").alias("ways")).filter("ways > 1").select("node")


def read_in(word: Column, back: Column) -> Column:
    return F.when(back, F.reverse(word)).otherwise(word)


def branches(steps: DataFrame, words: DataFrame, forked: DataFrame) -> DataFrame:
    """(word_id, back, own, place, node, label, into): the forks on each word's path.

    ``label`` leads from a fork to the next one on the path, ``into``, or to the word's end,
    where ``into`` is null.
    """
    on_path = join_back(steps.select("word_id", "back", "place", "node"), forked, "node", how="left_semi")
    paths = on_path.groupBy("word_id", "back").agg(
        F.sort_array(F.collect_list(F.struct("place", "node"))).alias("path")
    )
    return (
        paths.join(words.select("word_id", "word"), "word_id")
        .withColumn("own", read_in(F.col("word"), F.col("back")))
        .select("word_id", "back", "own", "path", F.posexplode("path").alias("at", "fork"))
        .withColumn("next", F.get("path", F.col("at") + 1))
        .select(
            "word_id",
            "back",
            "own",
            F.col("fork.place").alias("place"),
            F.col("fork.node").alias("node"),
            F.expr("substring(own, fork.place + 1, coalesce(next.place, length(own)) - fork.place)").alias("label"),
            F.col("next.node").alias("into"),
        )
    )


def _length_bit(length: Column) -> Column:
    """One of 64 bits for a length; the last one stands for all long words."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.least(length, F.lit(63)))


def edges_of(branch: DataFrame) -> DataFrame:
    """(node, letter, label, into, terminal, lengths): the edge table, one row per fork and
    letter.

    All words on an edge have its label. An edge to a word's end, or the empty one of a word
    that ends on a fork, has that word as ``terminal``. ``lengths`` has the bits of the
    lengths of its words. A word that another one seeks from a fork has that fork behind its
    own middle, so it is among them.
    """
    return branch.groupBy("node", F.substring("label", 1, 1).alias("letter")).agg(
        F.any_value("label").alias("label"),
        F.any_value("into").alias("into"),
        F.min(F.when(F.col("into").isNull(), F.col("word_id"))).alias("terminal"),
        F.bit_or(_length_bit(F.length("own"))).alias("lengths"),
    )


# ---------------------------------------------------------------- frontier


# A state has the bit of the length that it needs as ``aim``.


def _leads_to(aim: Column) -> Column:
    return F.col("lengths").bitwiseAND(aim) != 0


def _follow(states: DataFrame) -> DataFrame:
    """States after the edge they were joined with: its label, but for an edited first
    letter, must be what the word has from ``position`` on."""
    rest = F.expr("substring(label, 1 + skipped)")
    after = F.col("position") + F.length("label") - F.col("skipped")
    own = F.expr("substring(own, position + 1, length(label) - skipped)")
    return states.filter(own == rest).select(
        "word_id", "own", "aim", after.cast("int").alias("position"), F.col("into").alias("node"), "terminal"
    )


def replaced(branch: DataFrame, edges: DataFrame) -> DataFrame:
    """States after a letter was replaced by a later one at a fork."""
    own_letter = F.substring("own", F.col("place") + 1, F.lit(1))
    spawned = branch.filter(F.col("place") < F.length("own")).select(
        "word_id", "own", "node", own_letter.alias("own_letter"),
        (F.col("place") + 1).alias("position"), F.lit(1).alias("skipped"),
        _length_bit(F.length("own")).alias("aim"),
    )
    ways = edges.filter(F.col("letter") != "")
    later = (F.col("letter") > F.col("own_letter")) & _leads_to(F.col("aim"))
    return _follow(spawned.join(ways, "node").filter(later))


def deleted(branch: DataFrame) -> DataFrame:
    """States after a letter was left out at a fork, the last one of its run."""
    here = F.substring("own", F.col("place") + 1, F.lit(1))
    following = F.substring("own", F.col("place") + 2, F.lit(1))
    return branch.filter((F.col("place") < F.length("own")) & (here != following)).select(
        "word_id", "own", _length_bit(F.length("own") - 1).alias("aim"),
        (F.col("place") + 1).cast("int").alias("position"), "node",
        F.lit(None).cast("long").alias("terminal"),
    )


def step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """One level: every open state goes along the edge of its next letter."""
    letter = F.substring("own", F.col("position") + 1, F.lit(1))
    asked = (
        states.filter(F.col("node").isNotNull())
        .drop("terminal")
        .withColumn("letter", letter)
        .withColumn("skipped", F.lit(0))
    )
    return _follow(asked.join(edges, ["node", "letter"]).filter(_leads_to(F.col("aim"))))


def near_words(words: DataFrame, work: WorkTables) -> DataFrame:
    """(word_id, near_id) of different words, in both directions, each once.

    ``words`` (word_id, word) is a written table.
    """
    steps = work.write(places(words), "places")
    forked = work.write(forks(steps), "forks")
    branch = work.write(branches(steps, words, forked), "branches")
    edges = work.write(edges_of(branch), "edges")
    first = replaced(branch, edges).unionByName(step(deleted(branch), edges))
    frontier = work.write(first, "frontier")
    levels = []
    while True:
        levels.append(
            frontier.filter(
                F.col("terminal").isNotNull() & F.col("node").isNull() & (F.col("position") == F.length("own"))
            ).select("word_id", F.col("terminal").alias("near_id"))
        )
        if frontier.filter(F.col("node").isNotNull()).isEmpty():
            break
        frontier = work.write(step(frontier, edges), "frontier")
    one_way = reduce(DataFrame.unionByName, levels)
    other = one_way.select(F.col("near_id").alias("word_id"), F.col("word_id").alias("near_id"))
    return one_way.unionByName(other).distinct()


# ---------------------------------------------------------------- forms


def with_roots(forms: DataFrame, work: WorkTables) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form): where following forms ends.

    Each round doubles the distance that is followed. Forms get more frequent from word to
    word, so there are no circles and few rounds.
    """
    table = work.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = table.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = work.write(join_back(table, ahead, "root", how="left"), "roots")
        open_rows = joined.filter(F.col("further").isNotNull())
        table = joined.select("word", F.coalesce("further", "root").alias("root"))
        if open_rows.isEmpty():
            return table


def spelling_groups(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    rate: int = MISSPELT,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of the corpus.

    Words have ``least_length`` code points and ``least_count`` occurrences or more. The
    form of a word is the most frequent word near it (of equally frequent ones the first in
    code-point order), if that is at least twice as frequent as the word. The root is where
    following forms ends, the word itself if it has no form. ``n_near`` counts the words
    near it. Null and empty texts have no words, words of any length take part, a row
    counts as often as it is repeated, a null doc_id is an empty text in the checksum. An
    empty table gives no rows; other columns are not read.
    """
    work = WorkTables(docs.sparkSession, "spelling")
    counted = word_counts(docs, rate, least_length).filter(F.col("n") >= least_count)
    counted = work.write(counted, "counted")
    words = work.write(
        counted.withColumn("word_id", F.monotonically_increasing_id()), "words"
    )
    near = work.write(near_words(words, work), "near")
    named = words.select(F.col("word_id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    tops = work.write(
        near.join(named, "near_id")
        .groupBy("word_id")
        .agg(F.count("*").alias("n_near"), best.alias("best"))
        .select("word_id", "n_near", F.col("best.form").alias("top"), (-F.col("best.less")).alias("top_n")),
        "tops",
    )
    dominant = F.col("top_n") >= DOMINANCE * F.col("n")
    judged = work.write(
        words.join(tops, "word_id", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(dominant, F.col("top")).alias("form"),
            F.when(dominant, F.col("top_n")).alias("form_n"),
        ),
        "judged",
    )
    roots = with_roots(judged.filter(F.col("form").isNotNull()), work)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
