"""Intermediate tables in the folder that all executors share, and small helpers for the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words everywhere in this package: space and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors and the driver see. No folder of one machine can
    stand for it, so a session without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors and
    gives joins a plain exchange, which adaptive execution can split where a key is hot."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stashed tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nobody refers to any more, so that a chain of jobs
    needs the disk of its widest step and not of all steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tables that a worker process keeps between batches; tidied() empties them when a task ends.
CACHES: list[dict] = []


def _give_back() -> None:
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving memory back at the end of each task: worker processes are used again by the operators
    that follow, whose needs would add up with what they still hold."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return go
