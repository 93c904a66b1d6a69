"""Segments: named ranges of node ids, translated to and from nodes by an exploded equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.operators.graph import HapGraph
from plait.storage import settle


def node_segments(graph: HapGraph) -> DataFrame:
    """node_id, name, node_lo, node_hi of every visited node; without a translation a node is its own segment."""
    nodes = graph.visited.select("node_id", "seq", "len")
    if graph.segments is None:
        return nodes.withColumns({"name": F.col("node_id").cast("string"), "node_lo": F.col("node_id"), "node_hi": F.col("node_id") + 1})
    each = graph.segments.where("node_hi > node_lo").select("*", F.explode(F.expr("sequence(node_lo, node_hi - 1)")).alias("node_id"))
    own = {"name": F.coalesce("name", F.col("node_id").cast("string")), "node_lo": F.coalesce("node_lo", "node_id"), "node_hi": F.coalesce("node_hi", F.col("node_id") + 1)}
    return nodes.join(each, "node_id", "left").withColumns(own)


def segment_offsets(graph: HapGraph) -> DataFrame:
    """node_id, name, and the offset of the node in its segment, read forwards and backwards."""
    by = Window.partitionBy("name", "node_lo")
    ahead = by.orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    behind = by.orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda w: F.coalesce(F.sum("len").over(w), F.lit(0))
    return node_segments(graph).select("node_id", "name", zero(ahead).alias("offset_fwd"), zero(behind).alias("offset_rev"))


def segment_sequences(graph: HapGraph) -> DataFrame:
    """name, node_lo, node_hi and seq of the segments with visited nodes."""
    parts = F.array_sort(F.collect_list(F.struct("node_id", "seq")))
    return node_segments(graph).groupBy("name", "node_lo", "node_hi").agg(F.array_join(F.transform(parts, lambda p: p["seq"]), "").alias("seq"))


def links(graph: HapGraph) -> DataFrame:
    """Canonical edges between segments: from_name, from_rev, to_name, to_rev (edges inside a segment are left out)."""
    s = node_segments(graph)
    a = s.select(F.col("node_id").alias("from_id"), F.col("name").alias("from_name"), F.col("node_lo").alias("a_lo"), F.col("node_hi").alias("a_hi"))
    b = s.select(F.col("node_id").alias("to_id"), F.col("name").alias("to_name"), F.col("node_lo").alias("b_lo"), F.col("node_hi").alias("b_hi"))
    joined = graph.edges.join(a, "from_id").join(b, "to_id")
    leaves = F.when(~F.col("from_rev"), F.col("from_id") == F.col("a_hi") - 1).otherwise(F.col("from_id") == F.col("a_lo"))
    enters = F.when(~F.col("to_rev"), F.col("to_id") == F.col("b_lo")).otherwise(F.col("to_id") == F.col("b_hi") - 1)
    return joined.where(leaves & enters).select("from_id", "from_name", "from_rev", "to_id", "to_name", "to_rev")


def segment_walks(graph: HapGraph) -> DataFrame:
    """path_id, i, name, is_rev: a row for each visit of a segment, at its first node in the direction of the walk."""
    s = node_segments(graph).select("node_id", "name", "node_lo", "node_hi")
    first = F.when(~F.col("is_rev"), F.col("node_id") == F.col("node_lo")).otherwise(F.col("node_id") == F.col("node_hi") - 1)
    return graph.steps.join(s, "node_id").where(first).select("path_id", F.col("step").alias("i"), "name", "is_rev")


def translate_back(graph: HapGraph, ranges: DataFrame) -> DataFrame:
    """ranges (node_id, is_rev, start, length) -> name, is_rev, offset in the segment, length."""
    at = segment_offsets(graph)
    return ranges.join(at, "node_id").select("name", "is_rev", (F.when(F.col("is_rev"), F.col("offset_rev")).otherwise(F.col("offset_fwd")) + F.col("start")).alias("offset"), "length")


def from_translation(nodes: DataFrame, translation: DataFrame) -> DataFrame:
    """Segments (name, node_lo, node_hi) of an outside translation (node_id, name, is_rev, offset): where in which segment a node is.

    Every node must be in one segment, forwards; nodes of a run of ids in one segment must follow each other there from its start.
    """
    told = nodes.select("node_id", "len").join(translation, "node_id", "left")
    several = translation.groupBy("node_id").count().where("count > 1").join(nodes, "node_id", "left_semi")
    if told.where("name is null or is_rev").limit(1).count() or several.limit(1).count():
        raise ValueError("a node is not forward in exactly one segment")
    by_id = Window.partitionBy("name").orderBy("node_id")
    runs = told.withColumn("new", F.coalesce(F.col("node_id") - F.lag("node_id").over(by_id) > 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by_id))
    before = Window.partitionBy("name", "run").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = settle(runs.withColumn("expected", F.coalesce(F.sum("len").over(before), F.lit(0))))
    if placed.where("offset <> expected").limit(1).count():
        raise ValueError("a node is not at its place in its segment")
    return placed.groupBy("name", "run").agg(F.min("node_id").alias("node_lo"), (F.max("node_id") + 1).alias("node_hi")).select("name", "node_lo", "node_hi")
