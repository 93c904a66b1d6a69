"""Paths and their metadata: names, senses, filters, steps, offsets, haplotype ids, sequences."""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.functions import dna
from plait.operators.graph import HapGraph, path_order
from plait.operators.totals import running_total

GENERIC_SAMPLE = "_gbwt_ref"


def sense_of(sample: Column, references: Collection[str] | Column) -> Column:
    """GENERIC for the reserved sample name, REFERENCE for listed samples, else HAPLOTYPE."""
    listed = references if isinstance(references, Column) else (sample.isin(*references) if references else F.lit(False))
    return F.when(sample == GENERIC_SAMPLE, "GENERIC").when(listed, "REFERENCE").otherwise("HAPLOTYPE")


def path_name() -> Column:
    """contig; sample#haplotype#contig (no haplotype: sample#contig); or with #fragment for haplotypes."""
    generic, phase = F.col("contig"), F.col("haplotype").cast("string")
    reference = F.concat_ws("#", "sample", phase, "contig")
    return F.when(F.col("sense") == "GENERIC", generic).when(F.col("sense") == "REFERENCE", reference).otherwise(
        F.concat_ws("#", F.col("sample"), F.coalesce(phase, F.lit("0")), F.col("contig"), F.col("fragment").cast("string"))
    )


def described(paths: DataFrame) -> DataFrame:
    """paths with name, phase_block (haplotypes) or subrange_start (others, null at 0), and is_circular (never)."""
    hap = F.col("sense") == "HAPLOTYPE"
    return paths.select(
        "*",
        path_name().alias("name"),
        F.when(hap, F.col("fragment")).alias("phase_block"),
        F.when(~hap & (F.col("fragment") != 0), F.col("fragment")).alias("subrange_start"),
        F.lit(False).alias("is_circular"),
    )


def matching(paths: DataFrame, senses: Collection[str] | None = None, samples: Collection[str] | None = None, loci: Collection[str] | None = None) -> DataFrame:
    """Paths that meet every condition; None is no condition, an empty set matches nothing."""
    for column, wanted in (("sense", senses), ("sample", samples), ("contig", loci)):
        if wanted is not None:
            paths = paths.where(F.col(column).isin(*wanted)) if wanted else paths.where(F.lit(False))
    return paths


def find_path(paths: DataFrame, name: str) -> DataFrame:
    """The path of a name: a generic or reference path by its stored name, else the haplotype path that sample#haplotype#contig#block spells."""
    known = described(paths)
    named = (F.col("sense") != "HAPLOTYPE") & (F.col("name") == name)
    if not (parts := re.fullmatch(r"([^#]+)#([0-9]+)#(.+)#([0-9]+)", name)):
        return known.where(named)
    sample, haplotype, contig, block = parts.groups()
    phase = F.coalesce(F.col("haplotype").cast("string"), F.lit("0"))
    return known.where(named | ((F.col("sense") == "HAPLOTYPE") & (F.col("sample") == sample) & (phase == str(int(haplotype))) & (F.col("contig") == contig) & (F.col("fragment") == int(block))))


def path_handles(paths: DataFrame) -> DataFrame:
    """path_id and handle: named paths come first, numbered in their order; a haplotype path's handle is its id after all of these."""
    named = running_total(paths.where("sense <> 'HAPLOTYPE'").select("path_id"), F.lit(1), "handle", "path_id").select("path_id", "handle")
    first = paths.where("sense <> 'HAPLOTYPE'").count()
    return named.unionByName(paths.where("sense = 'HAPLOTYPE'").select("path_id", (F.col("path_id") + first).alias("handle")))


def step_counts(graph: HapGraph) -> DataFrame:
    """Steps of every path, empty ones too."""
    return graph.paths.join(graph.steps.groupBy("path_id").agg(F.count(F.lit(1)).alias("n_steps")), "path_id", "left").na.fill(0, ["n_steps"])


def node_visits(graph: HapGraph) -> DataFrame:
    """Visits of every node, in either orientation, on the stored paths."""
    return graph.steps.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_visits"))


def with_lengths(graph: HapGraph) -> DataFrame:
    return graph.steps.join(graph.nodes.select("node_id", "len"), "node_id")


def offsets(graph: HapGraph) -> DataFrame:
    """steps with len and bp_offset, the bases before the step."""
    return with_lengths(graph).withColumn("bp_offset", F.coalesce(F.sum("len").over(path_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def path_lengths(graph: HapGraph) -> DataFrame:
    """path_id, n_steps and bp of the paths with steps."""
    return with_lengths(graph).groupBy("path_id").agg(F.count(F.lit(1)).alias("n_steps"), F.sum("len").alias("bp"))


def neighbours(steps: DataFrame) -> DataFrame:
    """steps with the step before and after (null at the ends) and whether there is one."""
    return steps.select(
        "*",
        F.lag("node_id").over(path_order()).alias("prev_id"),
        F.lag("is_rev").over(path_order()).alias("prev_rev"),
        F.lead("node_id").over(path_order()).alias("next_id"),
        F.lead("is_rev").over(path_order()).alias("next_rev"),
    ).withColumns({"has_prev": F.col("prev_id").isNotNull(), "has_next": F.col("next_id").isNotNull()})


def named_paths(graph: HapGraph) -> DataFrame:
    """Generic and reference paths with their name, ends and step count. A name held twice is an error."""
    mine = described(graph.paths).where("sense <> 'HAPLOTYPE'")
    ends = graph.steps.groupBy("path_id").agg(
        F.min_by("node_id", "step").alias("first_id"), F.min_by("is_rev", "step").alias("first_rev"),
        F.max_by("node_id", "step").alias("last_id"), F.max_by("is_rev", "step").alias("last_rev"), F.count(F.lit(1)).alias("n_steps"),
    )
    return mine.join(ends, "path_id", "left").na.fill(0, ["n_steps"])


def check_unique_names(paths: DataFrame) -> None:
    twice = described(paths).where("sense <> 'HAPLOTYPE'").groupBy("name").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"paths with one name: {[r['name'] for r in twice]}")


def steps_on(graph: HapGraph, nodes: DataFrame | None = None, sense: str | None = None) -> DataFrame:
    """Visits of the given nodes (all if None) with their path, of one sense if given."""
    steps = graph.steps if nodes is None else graph.steps.join(nodes.select("node_id"), "node_id", "left_semi")
    paths = graph.paths if sense is None else graph.paths.where(F.col("sense") == sense)
    return steps.join(paths, "path_id")


def haplotype_ids(paths: DataFrame, most: int = 64) -> DataFrame:
    """paths with hap_id in [0, most): ranks of (sample, haplotype, contig) or, if there are too many, of a shorter key; else 0."""
    for key in (["sample", "haplotype", "contig"], ["sample", "haplotype"], ["sample"]):
        distinct = paths.select(*key).distinct().limit(most + 1).collect()
        if len(distinct) <= most:
            ranked = sorted((tuple(r) for r in distinct), key=lambda t: [(x is not None, x) for x in t])
            fields = ", ".join(f"k_{f.name} {f.dataType.simpleString()}" for f in paths.select(*key).schema)
            table = paths.sparkSession.createDataFrame([(*t, i) for i, t in enumerate(ranked)], f"{fields}, hap_id int")
            same = F.lit(True)
            for k in key:
                same = same & paths[k].eqNullSafe(table[f"k_{k}"])
            return paths.join(F.broadcast(table), same).drop(*(f"k_{k}" for k in key))
    return paths.withColumn("hap_id", F.lit(0))


def too_many_haplotypes(paths: DataFrame, most: int = 64) -> bool:
    """Whether haplotype_ids gives every path the id 0."""
    return paths.select("sample").distinct().limit(most + 1).count() > most


def sequences(graph: HapGraph, reverse: bool = False) -> DataFrame:
    """path_id and its sequence, optionally read on the other strand. Gathers a path, which is one value of the result."""
    read = graph.steps.join(graph.nodes.select("node_id", "seq"), "node_id").select("path_id", "step", dna.oriented("seq", "is_rev").alias("oseq"))
    parts = F.array_sort(F.collect_list(F.struct("step", "oseq")))
    whole = read.groupBy("path_id").agg(F.array_join(F.transform(parts, lambda p: p["oseq"]), "").alias("seq"))
    return whole.withColumn("seq", dna.reverse_complement("seq")) if reverse else whole


# Reference samples: a sorted list of names in one tag, separated by blanks.


def parse_reference_samples(tag: str | None) -> list[str]:
    return sorted(set((tag or "").split()))


def compose_reference_samples(samples: Collection[str]) -> str:
    return " ".join(sorted(set(samples)))


def present_samples(paths: DataFrame, samples: Collection[str]) -> list[str]:
    return sorted(r[0] for r in paths.where(F.col("sample").isin(*samples)).select("sample").distinct().collect()) if samples else []


def set_reference_samples(graph: HapGraph, samples: Collection[str]) -> tuple[HapGraph, int]:
    """The graph with those of the samples as references that it has, and their number."""
    kept = present_samples(graph.paths, [s for s in samples if s != GENERIC_SAMPLE])
    paths = graph.paths.withColumn("sense", sense_of(F.col("sample"), kept))
    return HapGraph(graph.nodes, paths, graph.steps, graph.segments, {**graph.tags, "reference_samples": compose_reference_samples(kept)}), len(kept)


def set_senses(samples: Collection[str], changes: dict[str, str]) -> list[str]:
    """The reference list after giving samples the senses REFERENCE or HAPLOTYPE."""
    out = set(samples)
    for name, sense in changes.items():
        if name == GENERIC_SAMPLE and sense != "GENERIC" or sense not in ("GENERIC", "REFERENCE", "HAPLOTYPE") or (sense == "GENERIC" and name != GENERIC_SAMPLE):
            raise ValueError(f"sample {name!r} cannot have sense {sense}")
        (out.add if sense == "REFERENCE" else out.discard)(name)
    return sorted(out)


def add_fragments(paths: DataFrame, order: list[Column]) -> DataFrame:
    """Paths without a fragment get the next number of their (sample, contig, haplotype); explicit repeats are an error."""
    key = ["sample", "contig", "haplotype"]
    fixed = paths.where("fragment is not null")
    if fixed.groupBy(*key, "fragment").count().where("count > 1").limit(1).count():
        raise ValueError("two paths have one name")
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    free = paths.where("fragment is null").withColumn("fragment", number.cast("bigint"))
    return fixed.unionByName(free)
