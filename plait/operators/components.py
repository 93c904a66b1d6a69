"""Weakly connected components and what is built on them: jobs, contigs, chunks, heads, topological order.

Components come from the star rounds of plait.operators.stars over the edges. Orders and head nodes are peeled off in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.operators.graph import HapGraph, restrict
from plait.operators.stars import components
from plait.operators.totals import running_total
from plait.storage import settle


def component_ids(graph: HapGraph) -> DataFrame:
    """node_id and component_id, the least node id of its component, for every visited node."""
    return settle(components_of(graph).join(graph.nodes.select("node_id"), "node_id", "left_semi"))


def components_of(graph: HapGraph) -> DataFrame:
    """As component_ids, of nodes with and without a label. A path links its nodes to its least one: as connected as its edges, and flatter."""
    links = settle(graph.steps.select("node_id", F.min("node_id").over(Window.partitionBy("path_id")).alias("least")))
    rooted = components(links, "node_id", "least").select(F.col("node").alias("node_id"), "root")
    return links.select("node_id").distinct().join(rooted, "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("component_id"))


def component_sizes(ids: DataFrame) -> DataFrame:
    return ids.groupBy("component_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def construction_jobs(ids: DataFrame, bound: int) -> DataFrame:
    """component_id, job_id and n_nodes: consecutive components share a job while its nodes stay within the bound.

    What a job holds depends on all before it, so one task reads the table of sizes, as it streams by.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, held = -1, 0
        for batch in batches:
            jobs = []
            for n in batch.column(1).to_pylist():
                if job < 0 or held + n > bound:
                    job, held = job + 1, 0
                held += n
                jobs.append(job)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(jobs, pa.int32()), batch.column(1)], ["component_id", "job_id", "n_nodes"])

    sizes = component_sizes(ids).repartition(1).sortWithinPartitions("component_id")
    return sizes.mapInArrow(pack, "component_id bigint, job_id int, n_nodes bigint")


def path_components(graph: HapGraph, ids: DataFrame) -> DataFrame:
    """path_id and component_id, that of the first node."""
    first = graph.steps.where("step = 0").select("path_id", "node_id")
    return first.join(ids, "node_id").select("path_id", "component_id")


def assign_paths(graph: HapGraph, ids: DataFrame, jobs: DataFrame, wanted=None) -> DataFrame:
    """path_id and job_id of the named (generic and reference) paths."""
    named = graph.paths.where("sense <> 'HAPLOTYPE'")
    named = named if wanted is None else named.where(wanted)
    return path_components(graph, ids).join(named.select("path_id"), "path_id", "left_semi").join(jobs, "component_id").select("path_id", "job_id")


def paths_by_job(graph: HapGraph, ids: DataFrame, jobs: DataFrame) -> DataFrame:
    """path_id, job_id and new_id: ids in the order of construction jobs, in each job named paths first, then by the old id. Paths without steps are left out."""
    sense = graph.paths.select("path_id", (F.col("sense") == "HAPLOTYPE").cast("int").alias("k"))
    placed = path_components(graph, ids).join(jobs.select("component_id", "job_id"), "component_id").join(sense, "path_id")
    keyed = placed.select("path_id", "job_id", F.struct("job_id", "k", "path_id").alias("key"))
    return running_total(keyed, F.lit(1), "new_id", "key").select("path_id", "job_id", "new_id")


def contig_names(graph: HapGraph, ids: DataFrame, wanted=None) -> DataFrame:
    """component_id and contig: of its first reference path, else of its first generic path, else component_<i> by order of ids."""
    named = graph.paths.where("sense <> 'HAPLOTYPE'")
    named = named if wanted is None else named.where(wanted)
    ranked = path_components(graph, ids).join(named, "path_id").withColumn("rank", F.struct(F.when(F.col("sense") == "REFERENCE", 0).otherwise(1), "path_id"))
    best = ranked.groupBy("component_id").agg(F.min_by("contig", "rank").alias("contig"))
    numbered = running_total(ids.select("component_id").distinct(), F.lit(1), "i", "component_id")
    return numbered.join(best, "component_id", "left").select("component_id", F.coalesce("contig", F.concat(F.lit("component_"), "i")).alias("contig"))


def chunk_paths(graph: HapGraph, ids: DataFrame, contig: str | None = None) -> DataFrame:
    """path_id and component_id of the paths in each chunk; with a contig, of the components that its paths touch (none if unknown)."""
    placed = path_components(graph, ids)
    if contig is None:
        return placed
    touched = placed.join(graph.paths.where(F.col("contig") == contig), "path_id", "left_semi").select("component_id").distinct()
    return placed.join(touched, "component_id", "left_semi")


def chunk(graph: HapGraph, ids: DataFrame, component_id: int) -> HapGraph:
    """One component as a graph of its own."""
    mine = path_components(graph, ids).where(F.col("component_id") == component_id)
    out = restrict(graph, F.lit(True))
    paths = graph.paths.join(mine, "path_id", "left_semi")
    nodes = graph.nodes.join(ids.where(F.col("component_id") == component_id), "node_id", "left_semi")
    return HapGraph(nodes, paths, graph.steps.join(mine, "path_id", "left_semi"), None, out.tags)


class Ways:
    """The oriented edges of a component, both ways, as sorted arrays. A handle is 2 * id + is_rev."""

    def __init__(self, nodes: np.ndarray, a: np.ndarray, b: np.ndarray):
        """nodes in order; a and b: canonical edges between them."""
        self.nodes = nodes
        self.handles = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes))
        other = (b ^ 1 != a) | (a ^ 1 != b)  # but for edges that are their own flipped copy
        a, b = np.concatenate([a, b[other] ^ 1]), np.concatenate([b, a[other] ^ 1])
        place = lambda x: np.searchsorted(self.handles, x)
        a, b = place(a), place(b)
        order = np.lexsort((b, a))
        self.to = b[order]
        self.begin = np.searchsorted(a[order], np.arange(len(self.handles) + 1))
        self.indegree = np.bincount(b, minlength=len(self.handles))

    def after(self, handle: int) -> list[int]:
        """Handles that follow one, in order."""
        i = np.searchsorted(self.handles, handle)
        return self.handles[self.to[self.begin[i] : self.begin[i + 1]]].tolist()

    def step(self, level: np.ndarray) -> np.ndarray:
        """Places that follow those of a level, once for each edge."""
        size = self.begin[level + 1] - self.begin[level]
        return self.to[np.repeat(self.begin[level] - np.cumsum(size) + size, size) + np.arange(size.sum())]


def heads_of(ways: Ways) -> list[int]:
    """Forward nodes without predecessors, if every node is reached from them in one orientation and without a cycle; else none."""
    left, side = ways.indegree.copy(), np.full(len(ways.nodes), -1)
    level = heads = np.flatnonzero(left[::2] == 0) * 2
    side[heads // 2] = 2
    freed = len(heads)
    while len(level):
        met, times = np.unique(ways.step(level), return_counts=True)
        if (np.diff(met // 2) == 0).any() or ((side[met // 2] != -1) & (side[met // 2] != met % 2)).any():
            return []
        side[met // 2] = met % 2
        left[met] -= times
        level = met[left[met] == 0]
        freed += len(level)
    return ways.nodes[heads // 2].tolist() if freed == len(ways.nodes) else []


def by_component(graph: HapGraph, ids: DataFrame, f, schema: str) -> DataFrame:
    """f(component_id, ways) for each component; the edges of a component come to one task, as order within it is sequential."""
    left, right = ids.groupBy("component_id"), component_edges(graph, ids).groupBy("component")
    return left.cogroup(right).applyInPandas(lambda n, x: f(int(n["component_id"].iloc[0]), Ways(np.sort(n["node_id"].to_numpy()), x["a"].to_numpy(), x["b"].to_numpy())), schema)


def component_edges(graph: HapGraph, ids: DataFrame) -> DataFrame:
    """component, a and b: canonical edges as pairs of handles."""
    code = lambda n, r: 2 * F.col(n) + F.col(r).cast("bigint")
    own = ids.select(F.col("node_id").alias("from_id"), F.col("component_id").alias("component"))
    return graph.edges.join(own, "from_id").select("component", code("from_id", "from_rev").alias("a"), code("to_id", "to_rev").alias("b"))


def head_nodes(graph: HapGraph, ids: DataFrame) -> DataFrame:
    """component_id, node_id of the heads of nice acyclic components."""

    def f(component: int, ways: Ways) -> pd.DataFrame:
        heads = heads_of(ways)
        return pd.DataFrame({"component_id": [component] * len(heads), "node_id": heads}, dtype="int64")

    return by_component(graph, ids, f, "component_id bigint, node_id bigint")


def order_of(ways: Ways) -> np.ndarray:
    """All handles in a topological order: by the longest way to them, then by id; none if there is a cycle."""
    degree, out = ways.indegree.copy(), []
    level = np.flatnonzero(degree == 0)
    while len(level):  # handles that only earlier ones lead to, by id
        out.append(level)
        met, times = np.unique(ways.step(level), return_counts=True)
        degree[met] -= times
        level = met[degree[met] == 0]
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return ways.handles[order] if len(order) == len(ways.handles) else np.zeros(0, np.int64)


def topological_order(graph: HapGraph, ids: DataFrame) -> DataFrame:
    """component_id, position, node_id, is_rev; nothing for components with a cycle."""

    def f(component: int, ways: Ways) -> pd.DataFrame:
        order = order_of(ways)
        return pd.DataFrame({"component_id": np.full(len(order), component), "position": np.arange(len(order)), "node_id": order >> 1, "is_rev": order % 2 == 1})

    return by_component(graph, ids, f, "component_id bigint, position bigint, node_id bigint, is_rev boolean")


def contig_paths(graph: HapGraph, ids: DataFrame, contig: str) -> DataFrame:
    """All paths in the components that a contig's paths touch."""
    return graph.paths.join(chunk_paths(graph, ids, contig).select("path_id"), "path_id", "left_semi")


def partition_chains(ids: DataFrame, chains: DataFrame) -> DataFrame:
    """chain_id and component_id for top-level chains (chain_id, node_id) from an outside decomposition: that of the least node."""
    return chains.join(ids, "node_id").groupBy("chain_id").agg(F.min_by("component_id", "node_id").alias("component_id"))
