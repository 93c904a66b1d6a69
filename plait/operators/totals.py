"""Running totals over a whole table: ranges are summed first, so no step sorts the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.storage import settle


def running_total(rows: DataFrame, value: Column, name: str, key: str = "ord") -> DataFrame:
    """rows with the total of value over the rows before. Ranges are summed first and their starts added."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(rows.withColumn("_v", value.cast("bigint")).repartitionByRange(n, key).withColumn("_p", F.spark_partition_id()))
    starts = ranged.groupBy("_p").agg(F.sum("_v").alias("t")).select("_p", (F.sum("t").over(Window.orderBy("_p")) - F.col("t")).alias("_start"))  # a row for each partition
    own = F.coalesce(F.sum("_v").over(Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(name, own).join(F.broadcast(starts), "_p").withColumn(name, F.col(name) + F.col("_start")).drop("_v", "_p", "_start")
