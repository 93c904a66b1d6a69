"""SimHash near-dedup by deletion-variant signatures.

A fingerprint is cut into so few segments that, within the distance, one of them differs in at most one bit. Each
segment is indexed once for every bit with that bit wiped out (a one-wildcard variant): segments that differ in at
most one bit agree in a variant. An equality join on (segment, wiped bit, rest) finds the pairs and verifies them;
a pair counts at its first agreeing variant only.

Links are made between distinct fingerprints, so exact copies (however many) are one node. A variant shared by
over HOT fingerprints goes another, also exact, way: each fingerprint in it is indexed under all values one bit
away and itself. Two fingerprints are within two bits if and only if they share such a value, at most 65 can share
one, and all that do are linked through the least. So the work stays linear in any group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.llm.common import arrow_map, settle
from plait.llm.components import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED, HOT, STEP = 42, 64, 1 << 15


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed integer."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        count += np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `width` words, ASCII lower case; of the whole sequence if there are fewer."""
    words = WORDS.findall((text or "").encode().lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    runs = max(1, len(words) - width + 1)
    spans = zip(starts[:runs].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed 64 bits) of every document; no words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("bigint"), text_col), run, "doc_id bigint, fp bigint")


def _bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _first_variant(difference: Column) -> Column:
    """The variant at which a pair counts: the first segment with at most one differing bit, and that bit (else bit 0)."""
    low, high = difference.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(difference, 32)
    place = lambda x: F.when(x == 0, F.lit(0)).otherwise(F.bit_count(x - 1))  # noqa: E731  of a single bit: the bits below it
    return F.when(F.bit_count(low) <= 1, place(low)).otherwise(place(high) + 32)


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) for distinct fingerprints fp of at most two differing bits: every pair, or within hot variants a star for each value in between."""
    bit = F.col("__bit")
    segment = F.when(bit < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    wiped = segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, cast(__bit % 32 as int))")))
    variants = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("__bit"))
        .select("fp", wiped.bitwiseOR(F.expr("shiftleft(cast(__bit as bigint), 32)")).alias("key"))
    )
    shared = settle(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # Merged at every size: variants are 64 rows a fingerprint, and a plan that broadcasts the shared keys while they are few says nothing of larger tables.
    mine = settle(variants.join(shared.hint("merge"), "key"))
    few = mine.where(F.col("n") <= hot).select("key", "fp")
    x, y = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = x.join(y, "key").where((F.col("a") < F.col("b")) & (_bits(F.col("a"), F.col("b")) <= 2) & (F.shiftrightunsigned("key", 32) == _first_variant(F.col("a").bitwiseXOR(F.col("b")))))
    crowded = mine.where(F.col("n") > hot).select("fp").distinct()
    around = crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("__bit")).select(
        "fp", F.when(F.col("__bit") == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, cast(__bit % 64 as int))"))).alias("key")
    )
    stars = around.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    star = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return near.select("a", "b").unionAll(star)


def simhash_components(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per document.

    Documents link where their fingerprints differ in at most two bits; component_id is the smallest doc_id that is
    reachable, the own one included. A null text is empty; texts without words have fingerprint zero and link
    like any other. Repeated rows are rows of one component; null ids count in no minimum (a component of
    null ids only has a null id). An empty table gives an empty result. Other columns are not read.
    """
    rows = settle(fingerprints(docs, width, id_col, text_col))
    fps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(fps))
    named = settle(linked.join(fps, linked["node"] == fps["fp"]).select("node", "root", "first"))
    least = settle(named.groupBy("root").agg(F.min("first").alias("least")))  # a root may have a third of all nodes: see below
    merged = named.join(least, "root").select("node", "least")
    # A fingerprint may belong to a third of all rows. With both sides written, both are shuffled for the last join alone,
    # and adaptive execution can split its partitions.
    ids = settle(fps.join(merged, fps["fp"] == merged["node"], "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return rows.join(ids.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
