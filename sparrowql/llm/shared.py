"""Small helpers that the operators share: tables, intermediate files, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Used only where the session names no shared folder and runs in one process (local runs and tests).
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints/sparrowql"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = LOCAL_CHECKPOINT_DIR
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Workspace:
    """Intermediate Parquet tables in the shared folder, which cut lineage.

    A lost executor costs only the tasks of the running stage, because each
    table is complete before the next stage reads it. ``drop`` removes a table
    that no returned DataFrame reads any more; what returned DataFrames read goes
    when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self._remove)

    def _remove(self) -> None:
        if self.spark.sparkContext._jsc is not None:  # else the session is stopped, and its folder is the cluster's to clean
            with contextlib.suppress(Exception):  # the JVM may be gone before
                self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)  # type: ignore[union-attr]
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def path(self, name: str) -> str:
        """Where a table of this name goes."""
        self.names.add(name)
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, schema=None) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema or df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")
        self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Removes every table but these."""
        for name in self.names - set(names):
            self.drop(name)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of DataFrames that are no longer used.

    Spark does so when the driver's JVM collects them, which may be hours later;
    an operator of several exchanges would hold all of them on disk till then.
    """
    gc.collect()
    spark._jvm.System.gc()


Batches = Iterator[pa.RecordBatch]


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which a Python worker gives freed memory back to the system.

    Workers wait for their next task with what they have; between stages that adds up.
    """

    def all_of(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return all_of


def slices(batch: pa.RecordBatch, text_col: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` of text each, and a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if sizes:
        yield batch.slice(start)


def unique_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name."""
    lowered = {c.lower() for c in taken}
    while wanted.lower() in lowered:
        wanted = "_" + wanted
    return wanted


def with_fields(schema: T.StructType, **kinds: str) -> T.StructType:
    """A new schema with further nullable fields."""
    out = T.StructType(list(schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, T.DataType.fromDDL(kind))
    return out
