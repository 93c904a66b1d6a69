"""Graph names and lineage: stable names from canonical text, relations between graphs, reachability.

Relations are a small table of metadata, so they are a Python object; names are made from the graph by one ordered
stream of lines, which a task reads.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.operators.graph import HapGraph
from plait.storage import discard, settle


def canonical_lines(graph: HapGraph) -> DataFrame:
    """node_id, k (order within the node) and line: an S-line for each node, then its canonical links, forward side first."""
    sign = lambda c: F.when(c, "-").otherwise("+")
    s = graph.visited.select("node_id", F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("to"), F.concat_ws("\t", F.lit("S"), "node_id", "seq").alias("line"))
    links = graph.edges.select(
        F.col("from_id").alias("node_id"),
        F.when(F.col("from_rev"), 2).otherwise(1).alias("side"),
        (2 * F.col("to_id") + F.col("to_rev").cast("bigint")).alias("to"),
        F.concat_ws("\t", F.lit("L"), "from_id", sign(F.col("from_rev")), "to_id", sign(F.col("to_rev"))).alias("line"),
    )
    return s.unionByName(links)


def canonical_gfa(graph: HapGraph) -> DataFrame:
    return canonical_lines(graph).orderBy("node_id", "side", "to").select("line")


def compute_name(graph: HapGraph) -> str:
    """SHA-256 of the canonical text.

    The hash needs the text in order. Tasks make pieces of it, and one task reads these, a sorted range after the other; the driver gets the name.
    """
    lines = canonical_gfa(graph).select(F.spark_partition_id().alias("p"), "line")
    pieces = settle(lines.mapInArrow(_pieces, "p int, i bigint, text binary"))
    spark = pieces.sparkSession
    before, starts = 0, []
    for p, n in sorted(tuple(r) for r in pieces.groupBy("p").count().collect()):  # a row for each task that made pieces
        starts.append((p, before))
        before += n
    numbered = pieces.join(F.broadcast(spark.createDataFrame(starts, "p int, before bigint")), "p").select((F.col("before") + F.col("i")).alias("i"), "text")
    ranges = numbered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "i").coalesce(1)
    found = ranges.mapInArrow(_digest, "name string").first()
    discard(pieces)
    return hashlib.sha256().hexdigest() if found is None else found["name"]


#: Bytes of a piece of text; a batch has some 10,000 of them.
PIECE = 16_384


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    i = 0
    for batch in batches:
        if batch.num_rows:
            text = ("\n".join(batch.column(1).to_pylist()) + "\n").encode()
            cut = [text[x : x + PIECE] for x in range(0, len(text), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[0].as_py()] * len(cut), pa.int32()), pa.array(range(i, i + len(cut)), pa.int64()), pa.array(cut, pa.binary())], ["p", "i", "text"])
            i += len(cut)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of numbered pieces. They come a range after the other, so those that wait for their turn are a range, not sorted, at most."""
    digest, following, waiting = hashlib.sha256(), 0, {}
    for batch in batches:
        waiting.update(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        while following in waiting:
            digest.update(waiting.pop(following))
            following += 1
    if waiting:
        raise RuntimeError("a piece of the text is missing")
    if following:
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["name"])


@dataclass
class GraphName:
    name: str = ""
    subgraphs: set[tuple[str, str]] = field(default_factory=set)
    translations: set[tuple[str, str]] = field(default_factory=set)

    @classmethod
    def from_headers(cls, lines: Iterable[str]) -> GraphName:
        """From GFA header lines (H with NM, SG, TL of type Z) or GAF ones (@RN, @SG, @TL); other fields are ignored, malformed ones an error."""
        out = cls()
        for line in lines:
            head, *rest = line.rstrip("\n").split("\t")
            if head == "H":
                for f in rest:
                    tag, kind, value = (f.split(":", 2) + ["", ""])[:3]
                    if kind == "Z" and tag == "NM":
                        out.name = value
                    elif kind == "Z" and tag in ("SG", "TL"):
                        pair = value.split(",")
                        if len(pair) != 2:
                            raise ValueError(f"malformed relation {f!r}")
                        (out.add_subgraph if tag == "SG" else out.add_translation)(*pair)
            elif head in ("@RN", "@SG", "@TL"):
                if len(rest) < (1 if head == "@RN" else 2):
                    raise ValueError(f"malformed line {line!r}")
                if head == "@RN":
                    out.name = rest[0]
                else:
                    (out.add_subgraph if head == "@SG" else out.add_translation)(rest[0], rest[1])
        return out

    @classmethod
    def from_tags(cls, tags: dict[str, str]) -> GraphName:
        out = cls(tags.get("pggname", ""))
        for key, add in (("subgraph", out.add_subgraph), ("translation", out.add_translation)):
            for pair in filter(None, tags.get(key, "").split(";")):
                a, _, b = pair.partition(",")
                add(a, b)
        return out

    def to_tags(self) -> dict[str, str]:
        text = lambda pairs: ";".join(",".join(p) for p in sorted(pairs))
        made = {"pggname": self.name, "subgraph": text(self.subgraphs), "translation": text(self.translations)}
        return {k: v for k, v in made.items() if v}

    def gfa_headers(self) -> list[str]:
        named = [f"H\tNM:Z:{self.name}"] if self.name else []
        return [*named, *(f"H\tSG:Z:{a},{b}" for a, b in sorted(self.subgraphs)), *(f"H\tTL:Z:{a},{b}" for a, b in sorted(self.translations))]

    def gaf_headers(self) -> list[str]:
        named = [f"@RN\t{self.name}"] if self.name else []
        return [*named, *(f"@SG\t{a}\t{b}" for a, b in sorted(self.subgraphs)), *(f"@TL\t{a}\t{b}" for a, b in sorted(self.translations))]

    def add_subgraph(self, a: str, b: str) -> None:
        if a and b and a != b:
            self.subgraphs.add((a, b))

    def add_translation(self, a: str, b: str) -> None:
        if a and b and a != b:
            self.translations.add((a, b))

    def add_relationships(self, other: GraphName) -> None:
        self.subgraphs |= other.subgraphs
        self.translations |= other.translations

    def named_after(self, parent: GraphName | None, relation: str | None = None, has_segments: bool = False) -> GraphName:
        """This name with the relation to a parent: "subgraph" or "translation"; None: translation if there are segment names."""
        out = GraphName(self.name, set(self.subgraphs), set(self.translations))
        if parent and parent.name:
            relation = relation or ("translation" if has_segments else "subgraph")
            (out.add_translation if relation == "translation" else out.add_subgraph)(out.name, parent.name)
            out.add_relationships(parent)
        return out

    def same(self, other: GraphName) -> bool:
        return bool(self.name) and self.name == other.name

    def _next(self, a: str, translate: bool) -> Iterator[tuple[str, bool]]:
        yield from ((y, False) for x, y in sorted(self.subgraphs) if x == a)
        if translate:
            yield from ((y, True) for x, y in sorted(self.translations) if x == a)

    def find_path(self, start: str, end: str, translate: bool = True) -> list[tuple[str, bool]]:
        """Names from start to end, each with whether the step after it is a translation; a shortest one, subgraph steps first."""
        if not start or not end:
            return []
        before: dict[str, tuple[str, bool] | None] = {start: None}
        queue = deque([start])
        while queue and end not in before:
            a = queue.popleft()
            for b, translated in self._next(a, translate):
                if b not in before:
                    before[b] = (a, translated)
                    queue.append(b)
        if end not in before:
            return []
        out, at, step = [], end, False
        while True:
            out.append((at, step))
            if before[at] is None:
                return out[::-1]
            at, step = before[at]

    def is_subgraph_of(self, other: GraphName) -> bool:
        both = GraphName(self.name, self.subgraphs | other.subgraphs, self.translations | other.translations)
        return bool(both.find_path(self.name, other.name, translate=False))

    def translates_to(self, other: GraphName) -> bool:
        both = GraphName(self.name, self.subgraphs | other.subgraphs, self.translations | other.translations)
        return bool(both.find_path(self.name, other.name))

    def describe(self, other: GraphName, mine: str, theirs: str) -> str:
        """How the two are related, as text for a reader."""
        both = GraphName(self.name, self.subgraphs | other.subgraphs, self.translations | other.translations)
        first, last = (self.name, mine), (other.name, theirs)
        path = both.find_path(self.name, other.name)
        if not path and (path := both.find_path(other.name, self.name)):
            first, last = last, first
        steps = [f"Graph {i} {'translates to' if t else 'is a subgraph of'} graph {i + 1}" for i, (_, t) in enumerate(path[:-1], 1)]
        names = [p for p, _ in path] or [first[0] or "(no name)", last[0] or "(no name)"]
        lines = [f"Name 1 is for {first[1]}", *steps, f"Name {len(path) or 2} is for {last[1]}", "With graph names:", *(f"{i}\t{n}" for i, n in enumerate(names, 1))]
        return "\n".join(lines) + "\n"


def reachable(relations: DataFrame) -> DataFrame:
    """(src, dst, hops): least hops between names over relations (kind, src, dst), by frontier joins until no new pair is found."""
    arcs = settle(relations.select("src", "dst").where("src <> dst").distinct())
    seen = frontier = arcs.withColumn("hops", F.lit(1))
    hop = 1
    while frontier.limit(1).count():
        hop += 1
        step = frontier.select("src", F.col("dst").alias("mid")).join(arcs.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = settle(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = settle(seen.unionByName(frontier))
    return seen
