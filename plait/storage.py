"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="plait-")


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Where none is set, a folder of our own in local mode, and an error on a cluster, whose machines would not see it."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (the master is {master})")
    return _own_folder()


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and go on from there: it is computed once, its lineage ends, and it outlives the executors that made it.

    A written table has the statistics of its files. A checkpoint would carry the estimates of the plan that made it,
    which multiply with every join of a loop until the planner itself no longer ends.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
