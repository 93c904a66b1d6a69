"""GFA 1 text to graph tables.

Lines are read with Spark's text source and typed by their first letter. Names become node ids by one equi-join on
segment names; ids of chopped segments and step numbers are running totals. Running totals over a whole file add up
partition totals first, so no step sorts the file in one task.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.operators.components import construction_jobs
from plait.operators.graph import HapGraph
from plait.operators.stars import components
from plait.operators.paths import GENERIC_SAMPLE, add_fragments, compose_reference_samples, parse_reference_samples, sense_of
from plait.operators.totals import running_total
from plait.storage import settle

MAX_NODE_LENGTH = 1024
KNOWN_VERSIONS = ("1.0", "1.1")
#: How P-line names are read: pattern, fields of its groups (S sample, C contig, H haplotype, F fragment), sense.
PAN_SN = (r"(.*)#([0-9]+)#(.*)", "SHC", "HAPLOTYPE")
ANY_NAME = (r"(.*)", "C", "GENERIC")
DEFAULT_FORMATS: Sequence[tuple[str, str, str]] = (ANY_NAME,)


@dataclass
class GfaError(ValueError):
    what: str

    def __str__(self) -> str:
        return self.what


def lines(spark: SparkSession, path: str) -> DataFrame:
    """ord (sorts as the file does), kind (H, S, L, P, W, Z or Q) and f, the tab-separated fields. Other lines are skipped."""
    raw = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord")
    )
    kind = F.substring("value", 1, 1)
    return settle(raw.where(kind.isin(*"HSLPWZQ")).select("ord", kind.alias("kind"), F.split("value", "\t", -1).alias("f")))


#: What is wrong with a line, by kind: conditions over the fields f, and what to say.
_FAULTS = {
    "H": [("exists(slice(f, 2, size(f)), x -> not rlike(x, '^[^:]{2}:[^:]:.*$'))", "malformed header field")],
    "S": [("coalesce(f[1], '') = ''", "no segment name"), ("coalesce(f[2], '') = ''", "no sequence")],
    "L": [
        ("coalesce(f[1], '') = '' or coalesce(f[3], '') = ''", "no segment name"),
        ("coalesce(f[2], '') not in ('+', '-') or coalesce(f[4], '') not in ('+', '-')", "no orientation"),
    ],
    "P": [("coalesce(f[1], '') = ''", "no path name"), ("not rlike(coalesce(f[2], ''), '^([^,]+[+-])(,[^,]+[+-])*$')", "no list of oriented segments")],
    "WZ": [
        ("exists(array(f[1], f[3]), x -> coalesce(x, '') = '')", "no sample or contig"),
        ("not rlike(coalesce(f[2], ''), '^[0-9]+$') or not rlike(coalesce(f[4], ''), '^([0-9]+|[*])$')", "no haplotype or start"),
        ("not rlike(coalesce(f[6], ''), '^([<>][^<>]+)+$')", "no walk"),
    ],
    "Q": [("coalesce(f[1], '') = ''", "no rule name"), ("not rlike(coalesce(f[2], ''), '^([<>][^<>]+)+$')", "no expansion")],
}


def _line_number(spark: SparkSession, path: str, fields: list[str]) -> int:
    """Where a line is first found in a file. Only read if there is something to report."""
    raw = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord"))
    return running_total(raw, F.lit(1), "before").where(F.col("value") == "\t".join(fields)).agg(F.min("before")).first()[0] + 1


def check_lines(spark: SparkSession, path: str, typed: DataFrame) -> None:
    """A malformed line is an error that names its number in the file."""
    fault = F.lit(None).cast("string")
    for kinds, faults in _FAULTS.items():
        for condition, what in reversed(faults):
            # get() gives null beyond the end, where [] may be an error
            test = re.sub(r"f\[(\d)\]", r"get(f, \1)", condition)
            fault = F.when(F.col("kind").isin(*kinds) & F.expr(test), what).otherwise(fault)
    bad = typed.withColumn("fault", fault).where("fault is not null").orderBy("ord").limit(1).collect()
    if bad:
        raise GfaError(f"line {_line_number(spark, path, bad[0]['f'])}: {bad[0]['fault']}")


def check_links(spark: SparkSession, path: str, typed: DataFrame, names: DataFrame) -> None:
    """A link to a segment that is not there is an error."""
    ends = typed.where("kind = 'L'").select("ord", "f", F.explode(F.array(F.get(F.col("f"), 1), F.get(F.col("f"), 3))).alias("name"))
    bad = ends.join(names, "name", "left_anti").orderBy("ord").limit(1).collect()
    if bad:
        raise GfaError(f"line {_line_number(spark, path, bad[0]['f'])}: no segment {bad[0]['name']}")


def of_kind(*kinds: str) -> Column:
    """The fields of lines of these kinds, null for others: Spark may test an expression before it filters the lines."""
    return F.when(F.col("kind").isin(*kinds), F.col("f"))


def required(f: Column, i: int, what: str) -> Column:
    """A field that must be there and not be empty. Null fields (lines of another kind, see of_kind) have null values and are no error."""
    value = F.get(f, i)
    return F.when(f.isNull(), F.lit(None).cast("string")).when(value.isNull() | (value == ""), F.raise_error(F.concat(F.lit(f"{what}: "), F.concat_ws(" ", f)))).otherwise(value)


def sign(value: Column, what: str) -> Column:
    """Whether an orientation is reverse; anything but + and - is an error."""
    return F.when(value.isNull(), F.lit(None).cast("boolean")).when(value == "+", False).when(value == "-", True).otherwise(F.raise_error(F.lit(f"{what}: no orientation")).cast("boolean"))


def headers(typed: DataFrame) -> DataFrame:
    """tag, type, value of every header field; a field of another form is an error."""
    each = typed.where("kind = 'H'").select(F.explode(F.slice(of_kind("H"), 2, 1 << 20)).alias("x"))
    form = "^([^:]{2}):([^:]):(.*)$"
    ok = F.when(F.col("x").rlike(form), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("malformed header field "), "x")))
    return each.select(F.regexp_extract(ok, form, 1).alias("tag"), F.regexp_extract(ok, form, 2).alias("type"), F.regexp_extract(ok, form, 3).alias("value"))


def segment_lines(typed: DataFrame) -> DataFrame:
    f = of_kind("S")
    return typed.where("kind = 'S'").select("ord", required(f, 1, "S-line without a name").alias("name"), F.upper(required(f, 2, "S-line without a sequence")).alias("seq"))


def link_lines(typed: DataFrame) -> DataFrame:
    f = of_kind("L")
    return typed.where("kind = 'L'").select(
        required(f, 1, "L-line").alias("from_name"), sign(required(f, 2, "L-line"), "L-line").alias("from_rev"), required(f, 3, "L-line").alias("to_name"), sign(required(f, 4, "L-line"), "L-line").alias("to_rev")
    )


def _symbols(text: Column) -> Column:
    """(pos, symbol, is_rev) of a walk like >a<b."""
    return F.transform(F.regexp_extract_all(text, F.lit("[<>][^<>]+"), F.lit(0)), lambda x, i: F.struct(i.alias("pos"), F.substring(x, 2, 1 << 20).alias("symbol"), (F.substring(x, 1, 1) == "<").alias("is_rev")))


def path_lines(typed: DataFrame) -> DataFrame:
    """P-lines: ord, name, symbols."""
    f = of_kind("P")
    parts = F.split(required(f, 2, "P-line without segments"), ",")
    each = F.transform(parts, lambda x, i: F.struct(i.alias("pos"), x.substr(F.lit(1), F.length(x) - 1).alias("symbol"), sign(F.right(x, F.lit(1)), "P-line").alias("is_rev")))
    return typed.where("kind = 'P'").select("ord", required(f, 1, "P-line without a name").alias("name"), each.alias("symbols"))


def walk_lines(typed: DataFrame) -> DataFrame:
    """W- and Z-lines: ord, sample, haplotype, contig, start, symbols. A start of * is 0; sample * is a generic path."""
    f = of_kind("W", "Z")
    start = F.when(required(f, 4, "W-line") == "*", F.lit("0")).otherwise(F.get(f, 4))
    return typed.where("kind in ('W', 'Z')").select(
        "ord", required(f, 1, "W-line").alias("sample"), required(f, 2, "W-line").cast("bigint").alias("haplotype"), required(f, 3, "W-line").alias("contig"),
        start.cast("bigint").alias("start"), _symbols(required(f, 6, "W-line without a walk")).alias("symbols"),
    )


def rule_lines(typed: DataFrame) -> DataFrame:
    """Q-lines: rule, pos, symbol, is_rev."""
    f = of_kind("Q")
    return typed.where("kind = 'Q'").select(required(f, 1, "Q-line without a name").alias("rule"), F.inline(_symbols(required(f, 2, "Q-line without an expansion"))))


def check_file(typed: DataFrame) -> list[str]:
    """Warnings; a file without segments, or without paths and walks, is an error."""
    kinds = dict(typed.groupBy("kind").count().collect())
    if not kinds.get("S"):
        raise GfaError("no segments")
    if not any(kinds.get(k) for k in "PWZ"):
        raise GfaError("no paths or walks")
    versions = [r[0] for r in headers(typed).where("tag = 'VN'").select("value").distinct().limit(10).collect()]
    return [f"unknown version {v}" for v in versions if v not in KNOWN_VERSIONS]


def needs_translation(segments: DataFrame, max_length: int) -> bool:
    """Whether some name is no positive integer or some segment is longer than a node may be (0: any length)."""
    row = segments.agg(F.bool_or(~F.col("name").rlike("^[0-9]+$") | F.col("name").rlike("^0+$")).alias("text"), F.max(F.length("seq")).alias("longest")).first()
    return bool(row["text"]) or bool(max_length and (row["longest"] or 0) > max_length)


def make_nodes(segments: DataFrame, max_length: int) -> tuple[DataFrame, DataFrame, bool]:
    """nodes, the range of every segment name, and whether ids were assigned (in file order, one for each piece)."""
    twice = segments.groupBy("name").count().where("count > 1").limit(1).collect()
    if twice:
        raise GfaError(f"segment {twice[0]['name']} twice")
    translated = needs_translation(segments, max_length)
    if not translated:
        ranges = segments.select("name", F.col("name").cast("bigint").alias("node_lo"), (F.col("name").cast("bigint") + 1).alias("node_hi"))
        nodes = segments.select(F.col("name").cast("bigint").alias("node_id"), "seq")
    else:
        size = F.lit(max_length) if max_length else F.length("seq")
        pieces = F.ceil(F.length("seq") / size).cast("bigint")
        placed = running_total(segments, pieces, "before").withColumn("n", pieces)
        ranges = placed.select("name", (F.col("before") + 1).alias("node_lo"), (F.col("before") + 1 + F.col("n")).alias("node_hi"))
        each = placed.select("before", "seq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"), size.alias("size"))
        nodes = each.select((F.col("before") + 1 + F.col("i")).alias("node_id"), F.substring(F.col("seq"), (F.col("i") * F.col("size") + 1).cast("int"), F.col("size").cast("int")).alias("seq"))
    return nodes.withColumn("len", F.length("seq").cast("bigint")), ranges, translated


def check_grammar(rules: DataFrame, names: DataFrame) -> None:
    """No clash with segment names, no rule under two symbols, no undefined symbol, no cycle."""
    if rules.select(F.col("rule").alias("name")).join(names, "name", "left_semi").limit(1).count():
        raise GfaError("a rule is named like a segment")
    if rules.groupBy("rule").count().where("count < 2").limit(1).count():
        raise GfaError("a rule is shorter than two symbols")
    known = names.unionByName(rules.select(F.col("rule").alias("name"))).distinct()
    if rules.select(F.col("symbol").alias("name")).join(known, "name", "left_anti").limit(1).count():
        raise GfaError("an undefined symbol")
    # Peel off the rules that stand on segments and peeled rules only; what cannot be peeled is on or above a cycle.
    left = settle(rules.select("rule", "symbol").join(rules.select(F.col("rule").alias("symbol")).distinct(), "symbol", "left_semi").distinct())
    while n := left.count():
        done = left.select("symbol").distinct().join(left.select(F.col("rule").alias("symbol")).distinct(), "symbol", "left_anti")
        left = settle(left.join(done, "symbol", "left_anti"))
        if left.count() == n:
            raise GfaError("rules in a cycle")


def expand(walks: DataFrame, rules: DataFrame) -> DataFrame:
    """walks (ord, pos array, symbol, is_rev) with every rule replaced by its expansion; a reversed rule is read backwards, flipped."""
    sizes = rules.groupBy("rule").agg(F.max("pos").alias("last"))
    body = rules.join(sizes, "rule").select(F.col("rule").alias("symbol"), F.col("pos").alias("r_pos"), "last", F.col("symbol").alias("r_symbol"), F.col("is_rev").alias("r_rev"))
    while True:
        hit = walks.join(body.select("symbol").distinct(), "symbol", "left_semi")
        if hit.limit(1).count() == 0:
            return walks
        at = F.when(F.col("is_rev"), F.col("last") - F.col("r_pos")).otherwise(F.col("r_pos"))
        grown = hit.join(body, "symbol").select("ord", F.concat("pos", F.array(at.cast("int"))).alias("pos"), F.col("r_symbol").alias("symbol"), (F.col("is_rev") != F.col("r_rev")).alias("is_rev"))
        walks = settle(walks.join(body.select("symbol").distinct(), "symbol", "left_anti").select("ord", "pos", "symbol", "is_rev").unionByName(grown))


def _named(p: DataFrame, formats: Sequence[tuple[str, str, str]]) -> DataFrame:
    """sample, haplotype, contig, fragment, given sense of P-lines by the first format that matches the whole name; none: an error."""
    def part(letter: str, fallback: Column) -> Column:
        out = F.raise_error(F.concat(F.lit("no format for path name "), F.col("name")))
        for pattern, letters, sense in reversed(formats):
            found = F.regexp_extract("name", f"^(?:{pattern})$", letters.index(letter) + 1) if letter in letters else fallback
            if letter == "S" and (sense == "GENERIC" or "S" not in letters):
                found = F.lit(GENERIC_SAMPLE)
            out = F.when(F.col("name").rlike(f"^(?:{pattern})$"), found).otherwise(out)
        return out

    none = F.lit(None).cast("string")
    return p.select("ord", part("S", none).alias("sample"), part("H", none).try_cast("bigint").alias("haplotype"), part("C", F.lit("")).alias("contig"), part("F", none).try_cast("bigint").alias("fragment"))


def from_gfa(spark: SparkSession, path: str, max_node_length: int = MAX_NODE_LENGTH, path_formats: Sequence[tuple[str, str, str]] = DEFAULT_FORMATS, jobs: int = 0) -> HapGraph:
    """The graph of a GFA file. Nodes that no path visits are dropped but keep their ids.

    Path ids follow the file: P-lines, then walks. With `jobs` they follow construction jobs of a jobs-th of the nodes or so: components of
    the file's links by their least node, packed together in that order; in a job P-lines first, then walks, as in the file.
    """
    typed = lines(spark, path)
    check_lines(spark, path, typed)
    for warning in check_file(typed):
        warnings.warn(warning, stacklevel=2)
    s = segment_lines(typed)
    nodes, ranges, translated = make_nodes(s, max_node_length)
    ranges = settle(ranges)
    check_links(spark, path, typed, s.select("name"))
    p, w, rules = path_lines(typed), walk_lines(typed), rule_lines(typed)
    each = p.select("ord", F.inline("symbols")).unionByName(w.select("ord", F.inline("symbols"))).select("ord", F.array(F.col("pos").cast("int")).alias("pos"), "symbol", "is_rev")
    if rules.limit(1).count():
        check_grammar(rules, s.select("name"))
        each = expand(each, rules)
    known = each.join(ranges, F.col("symbol") == F.col("name"), "left")
    lo, hi = F.col("node_lo"), F.col("node_hi")
    ids = F.when(lo.isNull(), F.raise_error(F.concat(F.lit("unknown segment "), "symbol")).cast("array<bigint>")).when(F.col("is_rev"), F.sequence(hi - 1, lo, F.lit(-1).cast("bigint"))).otherwise(F.sequence(lo, hi - 1))
    rows = known.select("ord", "pos", "is_rev", F.posexplode(ids).alias("i", "node_id"))
    step = F.row_number().over(Window.partitionBy("ord").orderBy("pos", "i")) - 1
    meta = _named(p, path_formats).withColumn("kind", F.lit(0)).unionByName(
        w.select("ord", F.when(F.col("sample") == "*", GENERIC_SAMPLE).otherwise(F.col("sample")).alias("sample"), F.when(F.col("sample") != "*", F.col("haplotype")).alias("haplotype"), "contig", F.col("start").alias("fragment"), F.lit(1).alias("kind"))
    )
    if jobs:
        owner = _job_of_lines(rows, nodes, link_edges(link_lines(typed), ranges), jobs)
        keyed = meta.join(owner, "ord", "left").withColumn("key", F.struct("job_id", "kind", "ord")).drop("job_id")
    else:
        keyed = meta.withColumn("key", F.struct("kind", "ord"))
    numbered = settle(running_total(keyed, F.lit(1), "path_id", "key"))
    tags = {r["tag"]: r for r in headers(typed).collect()}
    if "RS" in tags and tags["RS"]["type"] != "Z":
        raise GfaError("the RS tag is no string")
    references = parse_reference_samples(tags["RS"]["value"]) if "RS" in tags else []
    paths = add_fragments(numbered, [F.col("path_id")]).withColumn("sense", sense_of(F.col("sample"), references))
    steps = rows.select("ord", step.cast("bigint").alias("step"), "node_id", "is_rev").join(numbered.select("ord", "path_id"), "ord").select("path_id", "step", "node_id", "is_rev")
    kept = settle(steps)
    visited = nodes.join(kept.select("node_id").distinct(), "node_id", "left_semi")
    named = {"reference_samples": compose_reference_samples(references)} if references else {}
    if "NM" in tags:
        named["pggname"] = tags["NM"]["value"]
    return HapGraph(settle(visited), settle(paths.select("path_id", "sample", "contig", "haplotype", "fragment", "sense")), kept, settle(ranges.select("name", "node_lo", "node_hi")) if translated else None, named)


def _job_of_lines(visits: DataFrame, nodes: DataFrame, edges: DataFrame, jobs: int) -> DataFrame:
    """ord and job_id of the lines with paths: the job of the component of the first node."""
    linked = components(edges, "from_id", "to_id").select(F.col("node").alias("node_id"), "root")
    ids = settle(nodes.select("node_id").join(linked, "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("component_id")))
    packed = construction_jobs(ids, nodes.count() // jobs)
    first = visits.groupBy("ord").agg(F.min_by("node_id", F.struct("pos", "i")).alias("node_id"))
    return first.join(ids, "node_id").join(packed, "component_id").select("ord", "job_id")


def link_edges(links: DataFrame, ranges: DataFrame) -> DataFrame:
    """L-lines and the joints inside chopped segments as oriented edges of nodes (for components before paths are known)."""
    a = ranges.select(F.col("name").alias("from_name"), F.col("node_lo").alias("a_lo"), F.col("node_hi").alias("a_hi"))
    b = ranges.select(F.col("name").alias("to_name"), F.col("node_lo").alias("b_lo"), F.col("node_hi").alias("b_hi"))
    outer = links.join(a, "from_name").join(b, "to_name").select(
        F.when(F.col("from_rev"), F.col("a_lo")).otherwise(F.col("a_hi") - 1).alias("from_id"), "from_rev", F.when(F.col("to_rev"), F.col("b_hi") - 1).otherwise(F.col("b_lo")).alias("to_id"), "to_rev"
    )
    inner = ranges.where("node_hi - node_lo > 1").select(F.explode(F.sequence(F.col("node_lo"), F.col("node_hi") - 2)).alias("from_id"))
    no = F.lit(False)
    return outer.unionByName(inner.select("from_id", no.alias("from_rev"), (F.col("from_id") + 1).alias("to_id"), no.alias("to_rev"))).distinct()


