"""Ranks and running totals that do not pull a whole column into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def counts_before(
    histogram: DataFrame,
    value: str,
    count: str,
    out: str = "before",
    descending: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """For each value of a histogram, how many items sort ahead of it.

    ``histogram`` holds one row per distinct ``value``. The values are cut into
    ranges at approximate quantiles, each range is summed on its own, and the
    range totals (at most ``buckets`` rows) give the offset of every range. A
    heavy value is a single histogram row, so ranges stay even.
    """
    steps = [i / buckets for i in range(1, buckets)]
    bounds = histogram.select(F.percentile_approx(value, steps, 10_000)).scalar()
    ranged = (
        histogram.withColumn("_bounds", bounds)
        .withColumn("_range", F.size(F.filter("_bounds", lambda bound: bound < F.col(value))))
        .drop("_bounds")
    )
    direction = (lambda name: F.col(name).desc()) if descending else F.col
    across = Window.orderBy(direction("_range")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy("_range")
        .agg(F.sum(count).alias("_total"))
        .select("_range", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset"))
    )
    inside = (
        Window.partitionBy("_range")
        .orderBy(direction(value))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
        # one row per range: at most ``buckets`` rows
        .join(F.broadcast(offsets), "_range")
        .withColumn(out, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_range", "_inside", "_offset")
    )


def dense_ids(
    rows: DataFrame, key: str, out: str = "id", last_id: int = 0, digits: int = 3
) -> DataFrame:
    """Consecutive numbers ``last_id + 1 ...`` for the distinct strings in ``key``.

    Numbers follow the order of (md5(key), key). The first ``digits`` hex
    characters of the digest split the keys into ``16 ** digits`` even buckets
    that are numbered side by side; only bucket sizes are totalled globally. The digest is
    taken again where a bucket's keys lie, since it is longer than most keys.
    """
    hashed = rows.withColumn("_bucket", F.substring(F.md5(key), 1, digits))
    across = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(across), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_bucket").orderBy("_md5", key)
    return (
        hashed.repartition("_bucket")
        .withColumn("_md5", F.md5(key))
        .withColumn("_nr", F.row_number().over(inside))
        # at most 16 ** digits rows
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, (F.lit(last_id) + F.col("_offset") + F.col("_nr")).cast("long"))
        .drop("_md5", "_bucket", "_offset", "_nr")
    )
