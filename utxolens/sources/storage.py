"""Intermediate tables that cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own; a cluster without it is an error, because executors would not share it.
    """
    context = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="utxolens-")
    context.setCheckpointDir(folder)
    return folder


def read_if_present(
    spark: SparkSession, path: str, fields: str | None = None, fmt: str = "parquet"
) -> DataFrame | None:
    """A stored table, or None if nothing is stored there yet. Other faults are raised."""
    reader = spark.read.format(fmt)
    if fields:
        reader = reader.schema(fields)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in its form."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def is_folder(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.getFileStatus(place).isDirectory()


def listing(spark: SparkSession, folder: str) -> tuple:
    """What a folder of tables holds: it differs after a table was added to or rewritten."""
    files, place = _files(spark, folder)
    found = []
    for status in files.listStatus(place):
        size = status.getLen(), 1
        if status.isDirectory():
            total = files.getContentSummary(status.getPath())
            size = total.getLength(), total.getFileCount()
        found.append((status.getPath().getName(), status.getModificationTime(), *size))
    return tuple(sorted(found))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends, not when the driver happens to
    collect its garbage. For plans that nothing reads again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class WorkTables:
    """Tables written by one iterative job, under a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = (
            f"{shared_folder(spark)}/utxolens/"
            f"{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        )
        self._written = 0
        self._paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` as parquet and return a scan of it."""
        path = f"{self.folder}/{self._written:05d}-{label}"
        self._written += 1
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[table] = path
        return table

    def path(self, table: DataFrame) -> str:
        """Where a table of this job was written."""
        return self._paths[table]

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this folder that no later plan reads."""
        files, place = _files(self.spark, self.path(df))
        files.delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write one intermediate result and return a scan of it."""
    return WorkTables(df.sparkSession, name).write(df, "table")
