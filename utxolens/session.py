"""Spark session settings this library relies on."""

from __future__ import annotations

from math import ceil

from pyspark.sql import SparkSession

# All of these can be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot transaction or address must be split even when the operator above
    # the join would have liked to keep the join's partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# Stored bytes of input per partition of a shuffle, and the most that small ones are joined to.
INPUT_PER_PARTITION = 16 << 20
LARGEST_ADVISORY = 16 << 20


def tune(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built.

    Shuffles start with partitions in proportion to ``input_bytes``, never with fewer than
    the session asks for. With a fixed number the rows a task sorts or groups would grow
    with the input until it spills. Adaptive execution joins those that turn out small, up
    to a size that a task can hold when it is unpacked.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    asked_for = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(INITIAL_PARTITIONS, max(asked_for, ceil(input_bytes / INPUT_PER_PARTITION)))
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    spark.conf.set(ADVISORY_SIZE, min(in_bytes(spark.conf.get(ADVISORY_SIZE)), LARGEST_ADVISORY))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle starts with."""
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def build_session(
    app_name: str = "utxolens",
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
