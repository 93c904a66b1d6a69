"""Helpers shared by the training-data operators: tables, shared storage, Arrow plumbing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plait.storage import discard, settle

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "WORD", "arrow_map", "bounded_batches", "discard", "fan_out", "free_prefix", "let_go", "pieces", "settle", "table"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes that a Python worker holds of one Arrow batch at a time.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fan_out(spark: SparkSession) -> int:
    """How many partitions a shuffle gets in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded rows and bytes, without copying."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(BATCH_ROWS, int(n * BATCH_BYTES / max(batch.nbytes, 1))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def let_go() -> None:
    """Give freed memory back to the system. Python workers live on after a stage; only what they use should count against an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Where the session does not say how many bytes an Arrow batch may have: BATCH_BYTES, for what Spark and its Python workers hold of long texts at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over bounded pieces; the worker gives back what it has freed when a task ends."""

    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(pieces(batches))
        finally:
            let_go()

    return df.mapInArrow(run, schema)


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of df begins with: names made with them clash with none."""
    return "_" * (2 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))
