"""A graph as a folder of Parquet tables; k-mer indexes as tables bucketed by k-mer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plait.operators.graph import HapGraph

TAG = "plait."


def save(graph: HapGraph, path: str, mode: str = "error") -> None:
    """nodes, paths, steps, segments (if any) and tags. Steps are ordered within files, so that their statistics prune."""
    write = lambda df, name: df.write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}")
    write(graph.nodes.sortWithinPartitions("node_id"), "nodes")
    write(graph.paths, "paths")
    write(graph.steps.sortWithinPartitions("path_id", "step"), "steps")
    if graph.segments is not None:
        write(graph.segments, "segments")
    tags = [*graph.tags.items(), ("has_segments", str(graph.segments is not None).lower())]
    write(graph.nodes.sparkSession.createDataFrame(tags, "tag string, value string"), "graph_meta")


def load_tags(spark: SparkSession, path: str) -> dict[str, str]:
    """The tags alone. Tags are compared without case."""
    return {r["tag"].lower(): r["value"] for r in spark.read.parquet(f"{path}/graph_meta").collect()}


def load(spark: SparkSession, path: str) -> HapGraph:
    tags = load_tags(spark, path)
    segments = spark.read.parquet(f"{path}/segments") if tags.pop("has_segments", "false") == "true" else None
    nodes, paths, steps = (spark.read.parquet(f"{path}/{n}") for n in ("nodes", "paths", "steps"))
    return HapGraph(nodes, paths, steps, segments, tags)


def load_two(spark: SparkSession, paths: str, labels: str) -> HapGraph:
    """A graph from two stores: paths, steps and tags of one, nodes and segments of another that has every visited node."""
    own, other = load(spark, paths), load(spark, labels)
    if own.steps.select("node_id").distinct().join(other.nodes, "node_id", "left_anti").limit(1).count():
        raise ValueError("a visited node has no label in the second store")
    return HapGraph(other.nodes, own.paths, own.steps, other.segments, own.tags)


def save_index(index: DataFrame, table: str, tags: dict[str, str] | None = None, buckets: int = 64) -> None:
    """A hit index as a table: lookups by k-mer read one bucket, and joins of two indexes need no shuffle. Its tags (k, w, graph name and the like) are table properties."""
    index.write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer").format("parquet").saveAsTable(table)
    quoted = lambda x: "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if tags:
        index.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({', '.join(f'{quoted(TAG + k.lower())} = {quoted(v)}' for k, v in tags.items())})")


def load_index(spark: SparkSession, table: str, expected: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The hits of a saved index and its tags; tags other than those expected are an error."""
    properties = dict(tuple(r) for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect())
    tags = {k.removeprefix(TAG): v for k, v in properties.items() if k.startswith(TAG)}
    if wrong := {k: tags.get(k.lower()) for k, v in (expected or {}).items() if tags.get(k.lower()) != str(v)}:
        raise ValueError(f"the index has other tags than expected: {wrong}")
    return spark.table(table), tags
