"""Sub-path search: a search state is the set of visits (path_id, ori, end step) of a walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Walk = list[tuple[int, bool]]


def find(steps_bi: DataFrame, walk: Walk) -> DataFrame:
    """Visits (path_id, ori, step of the last node) of a walk on either strand; an empty walk has none.

    One scan: steps that equal the i-th node vote for a start i steps back, and starts with all votes win.
    """
    spark = steps_bi.sparkSession
    pattern = spark.createDataFrame([(i, n, r) for i, (n, r) in enumerate(walk)], "i int, node_id bigint, is_rev boolean")
    votes = steps_bi.join(F.broadcast(pattern), ["node_id", "is_rev"]).select("path_id", "ori", (F.col("step") - F.col("i")).alias("start"))
    whole = votes.groupBy("path_id", "ori", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(walk))
    return whole.where(F.lit(bool(walk))).select("path_id", "ori", (F.col("start") + len(walk) - 1).alias("step"))


def extend(state: DataFrame, steps_bi: DataFrame, backward: bool = False, length: int = 1) -> DataFrame:
    """Successor states with their next node: (path_id, ori, step, node_id, is_rev). Backward: to the left of a walk of `length` nodes."""
    at = F.col("step") - length if backward else F.col("step") + 1
    return state.select("path_id", "ori", at.alias("step")).join(steps_bi, ["path_id", "ori", "step"])


def follow_paths(state: DataFrame, steps_bi: DataFrame, backward: bool = False, length: int = 1) -> DataFrame:
    """Nodes that continue a walk, with the number of visits that go there. Ends of paths are skipped."""
    return extend(state, steps_bi, backward, length).groupBy("node_id", "is_rev").agg(F.count(F.lit(1)).alias("n_visits"))


def locate(state: DataFrame) -> DataFrame:
    """The paths of a state."""
    return state.select("path_id", "ori").distinct()
