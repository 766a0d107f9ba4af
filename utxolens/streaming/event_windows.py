"""Counts of events in tumbling windows of event time, with a watermark for late rows.

A window is open until the watermark, the latest event time seen less the delay allowed,
has passed its end. Rows of a window closed before their batch are late: the stream drops
them, and what it drops is the difference between what came and what the windows hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.sources.sinks import append_batch
from utxolens.streaming.feeds import drain

WIDTH = "1 day"
DELAY = "2 days"
COUNTS = "window_start timestamp, event_type string, events bigint, batch_id bigint"


def window_counts(events: DataFrame, width: str = WIDTH, delay: str = DELAY) -> DataFrame:
    """(window_start, event_type, events) of a stream of events. The state holds a row per
    open window and type; closed windows are dropped from it."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("window"), "event_type")
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("window_start"), "event_type", "events")
    )


def window_feed(
    events: DataFrame, target: str, checkpoint: str, width: str = WIDTH, delay: str = DELAY
) -> None:
    """Append the windows that each batch of events has changed."""
    drain(
        window_counts(events, width, delay),
        lambda batch, batch_id: append_batch(batch, target, batch_id),
        checkpoint,
        "update",
    )


def read_window_counts(parts: DataFrame) -> DataFrame:
    """The last count of each window; counts only grow."""
    return parts.groupBy("window_start", "event_type").agg(F.max("events").alias("events"))


def late_events(events: DataFrame, counts: DataFrame) -> DataFrame:
    """(event_type, events): how many rows of all ``events`` came too late for their window."""
    came = events.groupBy("event_type").agg(F.count("*").alias("came"))
    held = counts.groupBy("event_type").agg(F.sum("events").alias("held"))
    return came.join(held, "event_type", "left").select(
        "event_type", (F.col("came") - F.coalesce("held", F.lit(0))).alias("events")
    )
