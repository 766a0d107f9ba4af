"""Batch refresh from the last id read, with marks kept beside the results."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utxolens.operators.tokens import token_supply
from utxolens.operators.utxo import new_addresses, transaction_network
from utxolens.functions.ranking import dense_ids
from utxolens.sources.sinks import append_batch, rows_of
from utxolens.sources.storage import read_if_present

_MARKS = "job string, source string, last_id bigint, batch_id bigint"


def stored_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written before, or no rows of ``schema`` if there is none yet."""
    found = read_if_present(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


class Marks:
    """The highest id each job has read from each source, an append-only table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self, job: str) -> DataFrame:
        return stored_table(self.spark, self.path, _MARKS).filter(F.col("job") == job)

    def last_ids(self, job: str) -> dict[str, int]:
        """One entry per source of the job."""
        newest = self._rows(job).groupBy("source").agg(F.max("last_id").alias("last_id"))
        return {row.source: row.last_id for row in newest.collect()}

    def next_batch(self, job: str) -> int:
        last = self._rows(job).agg(F.max("batch_id")).first()[0]
        return 0 if last is None else last + 1

    def commit(self, job: str, batch_id: int, last_ids: dict[str, int]) -> None:
        rows = [(job, source, last_id, batch_id) for source, last_id in last_ids.items()]
        self.spark.createDataFrame(rows, _MARKS).coalesce(1).write.mode("append").parquet(self.path)


@dataclass(frozen=True)
class Increment:
    """The new rows of each source and the marks to store once they are handled."""

    batch_id: int
    rows: dict[str, DataFrame]
    last_ids: dict[str, int]

    def is_empty(self) -> bool:
        return not self.last_ids


def new_rows(df: DataFrame, last_id: int, up_to: int | None = None, key: str = "id") -> DataFrame:
    rows = df.filter(F.col(key) > last_id)
    return rows if up_to is None else rows.filter(F.col(key) <= up_to)


def next_increment(
    marks: Marks,
    job: str,
    sources: dict[str, DataFrame],
    key: str = "id",
    replay_from: int | None = None,
) -> Increment:
    """Rows after the marks of ``job``, up to the ids present now.

    ``replay_from`` reads again from an earlier id, for rows that came late.
    """
    seen = marks.last_ids(job)
    rows, last_ids = {}, {}
    for name, df in sources.items():
        start = seen.get(name, -1)
        if replay_from is not None:
            start = min(start, replay_from - 1)
        top = df.agg(F.max(key)).first()[0]
        top = start if top is None else max(top, start)
        rows[name] = new_rows(df, start, top, key)
        if top > start:
            last_ids[name] = top
    return Increment(marks.next_batch(job), rows, last_ids)


def run_increment(
    marks: Marks,
    job: str,
    sources: dict[str, DataFrame],
    operator: Callable[[dict[str, DataFrame]], DataFrame],
    target: str,
    key: str = "id",
    replay_from: int | None = None,
    log_path: str | None = None,
) -> int | None:
    """Apply ``operator`` to the new rows, append the result, then move the marks.

    Returns the batch id, or None when nothing is new. A run that dies before the
    marks are stored is repeated under the same batch id and replaces its output.
    """
    started = time.time()
    increment = next_increment(marks, job, sources, key, replay_from)
    if increment.is_empty():
        return None
    append_batch(operator(increment.rows), target, increment.batch_id)
    marks.commit(job, increment.batch_id, increment.last_ids)
    if log_path:
        log_run(marks.spark, log_path, job, "increment", started, time.time())
    return increment.batch_id


def log_run(
    spark: SparkSession, path: str, job: str, phase: str, started: float, ended: float
) -> None:
    """One row per phase with its start, end and duration in seconds."""
    row = [(job, phase, float(started), float(ended), float(ended - started))]
    fields = "job string, phase string, started double, ended double, seconds double"
    spark.createDataFrame(row, fields).write.mode("append").parquet(path)


# ------------------------------------------------------------ the jobs


def network_increment(
    delta: dict[str, DataFrame],
    tx: DataFrame,
    tx_in: DataFrame,
    tx_out: DataFrame,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Network rows that new ``tx``, ``tx_in`` and ``tx_out`` rows bring.

    Every transaction touched is worked out again over the full tables, since a new
    input may spend an old output; rows already in ``stored`` are left out.
    """
    touched = (
        delta["tx"]
        .select("id")
        .unionByName(delta["tx_in"].select(F.col("tx_in_id").alias("id")))
        .unionByName(delta["tx_out"].select(F.col("tx_id").alias("id")))
        .distinct()
    )
    some_tx = tx.join(touched, "id", "left_semi")
    network = transaction_network(some_tx, tx_in, tx_out, chosen=True)
    if stored is None:
        return network
    known = rows_of(stored, some_tx.select(F.col("hash").alias("tx_hash")))
    return network.join(known.select(*network.columns), network.columns, "left_anti")


def token_increment(delta: dict[str, DataFrame]) -> DataFrame:
    """Supply of the new mints alone; totals are merged when read."""
    return token_supply(delta["ma_tx_mint"])


def address_increment(delta: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """New addresses with ids that follow the largest one known."""
    last = known.agg(F.max("id")).first()[0] or 0
    fresh = new_addresses(delta["tx_out"], known)
    return dense_ids(fresh, "address", last_id=last).select("id", "address")


def unprocessed_blocks(block: DataFrame, register: DataFrame) -> DataFrame:
    """Blocks whose id is not in the register of processed blocks."""
    return block.join(register.select(F.col("block_id").alias("id")), "id", "left_anti")


def time_slice(block: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks with ``start <= time < end`` (epoch microseconds)."""
    return block.filter((F.col("time") >= start) & (F.col("time") < end))
