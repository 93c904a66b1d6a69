"""Graph tables to GFA 1 text, in three path modes, and other text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.operators import paths as P
from plait.operators import segments as S
from plait.operators.graph import HapGraph

MODES = ("default", "pan-sn", "ref-only")
NO_PHASE = "18446744073709551615"


def _sign(c: Column) -> Column:
    return F.when(c, "-").otherwise("+")


def segment_lines(graph: HapGraph) -> DataFrame:
    s = S.segment_sequences(graph)
    return s.select(F.lit(1).alias("part"), F.col("node_lo").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.concat_ws("\t", F.lit("S"), "name", "seq").alias("line"))


def link_lines(graph: HapGraph) -> DataFrame:
    links = S.links(graph)
    code = lambda n, r: 2 * F.col(n) + F.col(r).cast("bigint")
    line = F.concat_ws("\t", F.lit("L"), "from_name", _sign(F.col("from_rev")), "to_name", _sign(F.col("to_rev")), F.lit("0M"))
    return links.select(F.lit(2).alias("part"), code("from_id", "from_rev").alias("k1"), code("to_id", "to_rev").alias("k2"), line.alias("line"))


def walks(graph: HapGraph) -> DataFrame:
    """path_id, p_walk (a+,b-) and w_walk (>a<b) by segment names, and bp."""
    visits = S.segment_walks(graph)
    parts = F.array_sort(F.collect_list(F.struct("i", "name", "is_rev")))
    text = visits.groupBy("path_id").agg(parts.alias("x")).select(
        "path_id",
        F.array_join(F.transform("x", lambda v: F.concat(v["name"], _sign(v["is_rev"]))), ",").alias("p_walk"),
        F.array_join(F.transform("x", lambda v: F.concat(F.when(v["is_rev"], "<").otherwise(">"), v["name"])), "").alias("w_walk"),
    )
    return text.join(P.path_lengths(graph).select("path_id", "bp"), "path_id")


def path_text(graph: HapGraph, mode: str = "default") -> DataFrame:
    """P-lines and W-lines of a mode: default (generic paths as P, others as W), pan-sn (all as P), ref-only (generic paths as P, references as W)."""
    if mode not in MODES:
        raise ValueError(f"unknown path mode {mode!r}")
    rows = graph.paths.join(walks(graph), "path_id")
    fragment = F.coalesce("fragment", F.lit(0))
    suffix = F.when(fragment != 0, F.concat(F.lit("["), fragment, F.lit("]"))).otherwise("")
    as_p = lambda name: F.concat_ws("\t", F.lit("P"), F.concat(name, suffix), "p_walk", F.lit("*"))
    pan_sn = F.concat_ws("#", "sample", F.coalesce(F.col("haplotype").cast("string"), F.lit(NO_PHASE)), "contig")
    as_w = F.concat_ws("\t", F.lit("W"), "sample", F.coalesce(F.col("haplotype").cast("string"), F.lit(NO_PHASE)), "contig", fragment, fragment + F.col("bp"), "w_walk")
    generic = F.col("sense") == "GENERIC"
    if mode == "pan-sn":
        rows, line, part = rows, as_p(pan_sn), F.lit(3)
    else:
        rows = rows.where("sense <> 'HAPLOTYPE'") if mode == "ref-only" else rows
        line, part = F.when(generic, as_p(F.col("contig"))).otherwise(as_w), F.when(generic, 3).otherwise(4)
    return rows.select(part.alias("part"), F.col("path_id").alias("k1"), F.lit(0).cast("bigint").alias("k2"), line.alias("line"))


def header_lines(graph: HapGraph) -> list[str]:
    references = graph.tags.get("reference_samples")
    named = graph.tags.get("pggname") if graph.segments is None else None
    return ["H\tVN:Z:1.1" + (f"\tRS:Z:{references}" if references else ""), *([f"H\tNM:Z:{named}"] if named else [])]


def gfa_lines(graph: HapGraph, mode: str = "default") -> DataFrame:
    """part, k1, k2 (sort keys) and line of the whole file."""
    spark = graph.nodes.sparkSession
    head = spark.createDataFrame([(0, i, 0, x) for i, x in enumerate(header_lines(graph))], "part int, k1 bigint, k2 bigint, line string")
    return head.unionByName(segment_lines(graph)).unionByName(link_lines(graph)).unionByName(path_text(graph, mode))


def write_gfa(graph: HapGraph, out: str, mode: str = "default") -> None:
    """Text files under `out` whose names sort as the file does."""
    gfa_lines(graph, mode).orderBy("part", "k1", "k2").select("line").write.mode("overwrite").text(out)


def all_paths(graph: HapGraph) -> DataFrame:
    """Without metadata: every path a P-line named by its id."""
    return walks(graph).select("path_id", F.concat_ws("\t", F.lit("P"), F.col("path_id").cast("string"), "p_walk", F.lit("*")).alias("line"))


def translation_table(graph: HapGraph) -> DataFrame:
    """T name id,id,... for each segment."""
    s = graph.segments.where("node_hi > node_lo")
    return s.select("node_lo", F.concat_ws("\t", F.lit("T"), "name", F.array_join(F.expr("sequence(node_lo, node_hi - 1)"), ",")).alias("line"))


def sequence_lines(graph: HapGraph, both: bool = False) -> DataFrame:
    """path_id, k, line: the sequence of each path, and optionally its reverse complement after it."""
    made = P.sequences(graph).select("path_id", F.lit(0).alias("k"), F.col("seq").alias("line"))
    return made.unionByName(P.sequences(graph, reverse=True).select("path_id", F.lit(1).alias("k"), F.col("seq").alias("line"))) if both else made
