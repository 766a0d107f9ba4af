"""Streaming sources and the projections of their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from utxolens.schemas import schema


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    starting_offsets: str = "earliest",
    headers: bool = False,
) -> DataFrame:
    """A topic as a stream. Needs the Kafka connector package on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("includeHeaders", str(headers).lower())
        .load()
    )


def message_values(messages: DataFrame) -> DataFrame:
    """The value of each message as text."""
    return messages.select(F.col("value").cast("string").alias("value"))


def messages_with_headers(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "headers",
    )


def parsed_messages(messages: DataFrame, payload: StructType) -> DataFrame:
    """Message values parsed as JSON objects of a known schema."""
    return (
        message_values(messages)
        .select(F.from_json("value", payload).alias("record"))
        .select("record.*")
    )


def file_stream(
    spark: SparkSession,
    folder: str,
    record: StructType | str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """New files of a folder as a stream. ``record`` is a schema or a ledger table name."""
    reader = spark.readStream.format(fmt).schema(
        schema(record) if isinstance(record, str) else record
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)
