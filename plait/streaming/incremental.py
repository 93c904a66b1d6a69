"""Counts over paths that keep arriving: the same aggregations, over a stream of steps.

The reference computations are all batch; this is for stores to which paths are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visit_counts(steps: DataFrame) -> DataFrame:
    """node_id and visits so far, of a stream (complete or update mode) or a table of steps."""
    return steps.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_visits"))


def path_totals(steps: DataFrame) -> DataFrame:
    """path_id, steps and the last step so far."""
    return steps.groupBy("path_id").agg(F.count(F.lit(1)).alias("n_steps"), F.max("step").alias("last_step"))
