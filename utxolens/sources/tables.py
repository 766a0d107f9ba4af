"""Batch sources: parquet or any other format, JSON, CSV, stream dumps, rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from utxolens.schemas import schema


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    columns: list[str] | None = None,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Scan ``root/table`` with its declared schema, narrowed to ``columns``.

    ``fmt`` may name any data source on the class path, so that a document
    store or table format can stand behind the same call.
    """
    reader = spark.read.format(fmt).schema(schema(table, columns)).options(**(options or {}))
    return reader.load(f"{root}/{table}")


def read_json(
    spark: SparkSession, path: str | list[str], table: str, columns: list[str] | None = None
) -> DataFrame:
    """JSON lines; ``path`` may be a glob such as ``folder/*.json``."""
    return spark.read.schema(schema(table, columns)).json(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Name and size of the files of a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    )


def read_network_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema("network_csv")).option("header", True).csv(path)


def read_vertices(spark: SparkSession, root: str, label: str, fmt: str = "parquet") -> DataFrame:
    """Vertices of one label, as written by :func:`utxolens.sources.sinks.upsert_vertices`."""
    return spark.read.format(fmt).load(f"{root}/vertices/{label}")


def read_stream_dump(spark: SparkSession, path: str, payload: StructType) -> DataFrame:
    """Text lines holding ``{'value': '<json>'}`` records, parsed to ``payload``.

    Lines may be written with single quotes, as a printed dictionary is.
    """
    envelope = F.from_json(
        "value", "struct<value: string>", {"allowSingleQuotes": "true"}
    )
    return (
        spark.read.text(path)
        .select(envelope.getField("value").alias("value"))
        .select(F.from_json("value", payload).alias("record"))
        .select("record.*")
    )


def rows(spark: SparkSession, data: Iterable[tuple], columns: list[str] | str) -> DataFrame:
    """A small table typed in by hand."""
    return spark.createDataFrame(list(data), columns)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make each table visible to ``spark.sql`` under its name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
