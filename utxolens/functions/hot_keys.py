"""Joins of an aggregate back to the rows it came from, with hot keys that can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEAL = "_deal"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with column ``DEAL``, the bit of a digest of the keys that :func:`join_back` joins on."""
    digest = F.coalesce(F.pmod(F.xxhash64(*keys), F.lit(2)).cast("byte"), F.lit(0).cast("byte"))
    return df.withColumn(DEAL, digest)


def join_back(
    rows: DataFrame, totals: DataFrame, *keys: str, how: str = "inner", keep: bool = False
) -> DataFrame:
    """``rows`` joined with ``totals``, which has one row per value of ``keys``.

    An aggregate leaves its rows partitioned by the key, so a plain join of the two
    shuffles one side at most, and adaptive execution can only split a hot key of a
    join whose both sides were shuffled for it. A bit of a digest of the keys as one more
    join key makes both sides be dealt anew: the aggregate is small, the rows had to move
    anyhow, and the rows of a hot key are then read by several tasks, each beside the
    one row of totals. A single bit adds next to nothing to the bytes that move. With
    ``keep`` the bit stays as column ``DEAL``: rows grouped by the keys and it next need no
    further shuffle, unless a hot key was split. The bit is never null, and says so: a filter
    on it would keep a table that stands on both sides from being shuffled once for both.
    """
    joined = dealt(rows, *keys).join(dealt(totals, *keys), [*keys, DEAL], how)
    return joined if keep else joined.drop(DEAL)
