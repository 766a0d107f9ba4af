"""Sinks. Every write can be repeated without doubling rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utxolens.sources.storage import materialize, read_if_present


def append_batch(
    df: DataFrame, path: str, batch_id: int, fmt: str = "parquet", files: int | None = None
) -> None:
    """Append one batch. A retry of the batch replaces what it wrote before.

    ``files`` merges the output into that many files; off by default, since one
    file means one writing task.
    """
    if files:
        df = df.coalesce(files)
    df.write.format(fmt).mode("overwrite").save(f"{path}/batch_id={batch_id}")


def overwrite(df: DataFrame, path: str, fmt: str = "parquet", files: int | None = None) -> None:
    if files:
        df = df.coalesce(files)
    df.write.format(fmt).mode("overwrite").save(path)


def write_network_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def upsert_vertices(df: DataFrame, root: str, label: str, key: str, batch_id: int) -> DataFrame:
    """Add the vertices whose key is not stored yet; returns the ones added."""
    path = f"{root}/vertices/{label}"
    fresh = df.dropDuplicates([key])
    known = read_if_present(df.sparkSession, path)
    if known is not None:
        earlier = known.filter(F.col("batch_id") != batch_id).select(key)
        fresh = fresh.join(earlier, key, "left_anti")
    append_batch(fresh, path, batch_id)
    return df.sparkSession.read.parquet(f"{path}/batch_id={batch_id}")


def rows_of(stored: DataFrame, group: DataFrame) -> DataFrame:
    """Rows of ``stored`` whose value in the one column of ``group`` is among those there.

    A batch seldom has much in common with what is stored, so the values found in both
    are written first: if they are few, neither the stored rows nor the rows that are
    compared with them are shuffled.
    """
    (key,) = group.columns
    both = materialize(stored.select(key).distinct().join(group, key, "left_semi"), "both")
    return materialize(stored.join(both, key, "left_semi").select(*stored.columns), "stored-before")


def write_edges(
    edges: DataFrame,
    vertices: DataFrame | None,
    root: str,
    edge_type: str,
    batch_id: int,
    src: str = "src",
    dst: str = "dst",
    group: DataFrame | None = None,
) -> None:
    """Store the edges whose two ends exist; an edge already stored is left out.

    Ends and all properties together identify an edge. Without ``vertices`` the edges are
    distinct and their ends exist, so they need not move to find out. ``group`` has one
    column of the edges with all values it takes in them: only stored edges with one of
    these are compared, looked up by that column alone first.
    """
    path = f"{root}/edges/{edge_type}"
    kept = edges
    if vertices is not None:
        ids = vertices.select("id")
        kept = (
            edges.distinct()
            .join(ids.withColumnRenamed("id", src), src, "left_semi")
            .join(ids.withColumnRenamed("id", dst), dst, "left_semi")
        )
    known = read_if_present(edges.sparkSession, path)
    if known is not None and group is not None:
        known = rows_of(known.filter(F.col("batch_id") != batch_id), group)
    if known is not None:
        earlier = known.filter(F.col("batch_id") != batch_id).select(
            *[F.col(name).alias(f"_{name}") for name in edges.columns]
        )
        # equal also where both are null
        same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in edges.columns]
        kept = kept.join(earlier, same, "left_anti")
    append_batch(kept, path, batch_id)


def upsert_snapshot(df: DataFrame, path: str, key: str = "snapshot_ts") -> None:
    """Replace the rows of the snapshots in ``df`` and leave the others alone."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def to_pandas(df: DataFrame, limit: int):
    """At most ``limit`` rows on the driver."""
    return df.limit(limit).toPandas()


def show(df: DataFrame, limit: int = 20) -> None:
    df.show(limit, truncate=False)
