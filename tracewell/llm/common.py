"""What several operators share: scratch tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where local tests keep scratch tables when the session names no shared folder.
_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may lack it; it then gets a temporary folder of this process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="tracewell-"))
        atexit.register(_LOCAL[0].cleanup)
    return f"file://{_LOCAL[0].name}"


#: Folders of this process's scratch tables; results read them lazily, so they go when the process ends.
_ROOTS: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    for spark, root in _ROOTS:
        if spark.sparkContext._jsc is not None:  # else the session is stopped, and its file systems with it
            delete(spark, root)


def delete(spark: SparkSession, root: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables that cut the lineage of an operator. Each is Parquet in the shared folder, so that it outlives any executor."""

    def __init__(self, spark: SparkSession, name: str, batch_rows: int | None = None):
        """``batch_rows`` bounds the Arrow batches of what is saved, for rows that carry whole texts; by default the session's bound holds."""
        self.spark = spark
        self.batch_rows = batch_rows
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if not _ROOTS:
            atexit.register(_sweep)
        _ROOTS.append((spark, self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again; a later call with the same name needs ``drop`` first."""
        before = self.spark.conf.get(_BATCH_ROWS)
        if self.batch_rows is not None:
            self.spark.conf.set(_BATCH_ROWS, str(min(self.batch_rows, int(before)) if int(before) > 0 else self.batch_rows))
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(_BATCH_ROWS, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        """A table that was saved."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def row_type(df: DataFrame, columns: list[str] | None = None, **more: str) -> T.StructType:
    """The type of rows that hold some columns of ``df`` (all by default) and then further ones, given as name=type."""
    kept = [T.StructField(f.name, f.dataType) for f in df.schema.fields if columns is None or f.name in columns]
    return T.StructType(kept + [T.StructField(n, T._parse_datatype_string(k)) for n, k in more.items()])


#: Rows of one number each that are broadcast at most, after they were counted.
BROADCAST_KEYS = 1_000_000


def having(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose column ``on`` is among ``keys`` (a table of that one column, without repeats).

    Keys are broadcast if they are no more than ``BROADCAST_KEYS``, so that wide rows stay where they are; else both sides are shuffled.
    """
    return df.join(_bounded(keys), on, "left_semi")


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose column ``on`` is null or not among ``keys``, joined as ``having`` does."""
    return df.join(_bounded(keys), on, "left_anti")


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
