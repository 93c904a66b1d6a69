"""Mixing sources to target weights by temperature.

The weight of a source is its token share to a power a, normalised: a = 1 keeps the shares, a = 0 makes all sources
equal. Tokens are those of a byte-level BPE, or any column. The exponent is bisected to the largest that meets a target
entropy, or to the least that keeps a limit on repetition (entropy falls and repetition falls as a grows). Weights
times a token budget give each source whole passes and a remainder.

A keyed hash permutes the documents; its leading bits cut the permutation into blocks, and blocks into smaller blocks.
The remainder of a source takes whole blocks from the front; of the block where it ends whole smaller blocks, and of the
smallest the documents up to a cut in the permutation. So all that a document needs is its own hash and one row
of its source: no source, however large, is sorted or gathered, and only the one cut block of a source is ordered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.common import arrow_map, free_prefix, settle
from plait.llm.token_output import encoding

#: Sources whose sums go to the driver, and whose table is broadcast; with more of them the same sums are made in Spark. Documents of a block, about.
FEW_SOURCES, BLOCK_DOCS, TOP = 100_000, 4096, (1 << 63) - 1

#: Of an exponent a, with shares p of tokens t: sum of p ** a, sum of p ** a * ln p, largest t / p ** a, largest p ** a / t.
Moments = Callable[[float], tuple[float, float, float, float]]


def weights(tokens: Sequence[float], exponent: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raw) for r in raw]


def entropy(w: Sequence[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def bisect_exponent(good: Callable[[float], bool], want_large: bool, rounds: int = 60) -> float:
    """The largest (want_large) or least exponent in [0, 1] that is good; if none is, the end nearest to it."""
    low, high = 0.0, 1.0
    end, other = (high, low) if want_large else (low, high)
    if found := good(end):
        return end
    if not good(other):
        return other if found else end
    for _ in range(rounds):
        mid = (low + high) / 2
        if good(mid) == want_large:
            low = mid
        else:
            high = mid
    return low if want_large else high


def moments_of(tokens: Sequence[int]) -> Moments:
    some = [t for t in tokens if t]
    logs = [math.log(t / sum(some)) for t in some]

    def at(a: float) -> tuple[float, float, float, float]:
        raw = [math.exp(a * x) for x in logs]
        return sum(raw), sum(r * x for r, x in zip(raw, logs, strict=True)), max(t / r for t, r in zip(some, raw, strict=True)), max(r / t for t, r in zip(some, raw, strict=True))

    return at


def moments_in(sums: DataFrame, total: int) -> Moments:
    """The same for a table with a column t, however many rows it has."""
    log = F.log(F.col("t") / F.lit(total))

    def at(a: float) -> tuple[float, float, float, float]:
        raw = F.exp(F.lit(a) * log)
        return tuple(sums.where("t > 0").agg(F.sum(raw), F.sum(raw * log), F.max(F.col("t") / raw), F.max(raw / F.col("t"))).first())

    return at


def solve(at: Moments, n: int, target_entropy: float | None, repetition: float | None, budget: int | None) -> tuple[float, int]:
    """Exponent and budget for n sources with tokens. target_entropy: a share of the entropy of equal weights. repetition: the most passes over a source.

    budget None: enough for a whole pass over every source. Of two targets, the limit on repetition prevails.
    """
    if not n:
        return 1.0, 0

    def entropy_at(a: float) -> float:
        total, by_log, *_ = at(a)
        return math.log(total) - a * by_log / total

    def needed(a: float) -> float:
        total, _, largest, _ = at(a)
        return budget if budget is not None else total * largest

    def passes(a: float) -> float:
        total, _, _, densest = at(a)
        return needed(a) / total * densest

    exponent = 1.0
    if target_entropy is not None:
        exponent = bisect_exponent(lambda a: entropy_at(a) >= target_entropy * math.log(n), want_large=True)
    if repetition is not None:
        least = bisect_exponent(lambda a: passes(a) <= repetition, want_large=False)
        exponent = max(exponent, least) if target_entropy is not None else least
    return exponent, math.ceil(needed(exponent))


def exponent_for(tokens: Sequence[int], target_entropy: float | None, repetition: float | None, budget: int | None) -> tuple[float, int]:
    """solve() for a list of token sums."""
    n = sum(t > 0 for t in tokens)
    return solve(moments_of(tokens) if n else (lambda a: (0.0, 0.0, 0.0, 0.0)), n, target_entropy, repetition, budget)


def permuted(id_col: str, seed: int) -> Column:
    """A document's place in the permutation."""
    return F.xxhash64(F.col(id_col), F.lit(seed)).bitwiseAND(F.lit(TOP))


def counted(docs: DataFrame, tokens: Column | None, seed: int, id_col: str, text_col: str, source_col: str, path: str | None, pattern: str) -> DataFrame:
    """doc_id, source, n_tokens and place of every document, written once. tokens None: the BPE's count of each text."""
    mine = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), permuted(id_col, seed).alias("place")]
    if tokens is not None:
        return settle(docs.select(*mine, F.coalesce(tokens, F.lit(0)).cast("bigint").alias("n_tokens")))
    rows, path = docs.select(*mine, F.col(text_col).alias("text")), path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(encode(t.as_py() or "")) for t in batch.column(3)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n)], ["doc_id", "source", "place", "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return settle(arrow_map(rows, run, f"{kinds}, n_tokens bigint"))


def plan(rows: DataFrame, target_entropy: float | None, repetition: float | None, budget: int | None) -> tuple[DataFrame, bool]:
    """For rows (source, n_tokens, place): source, source_tokens, weight, token_budget, passes and cut (places before it get one pass more), written; and whether that may be broadcast."""
    sums = settle(rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")))
    n_sources, some, total, n = sums.agg(F.count(F.lit(1)), F.count_if(F.col("t") > 0), F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = n_sources <= FEW_SOURCES
    small = F.broadcast if few else lambda df: df
    at = (moments_of([r["t"] for r in sums.select("t").collect()]) if few else moments_in(sums, total)) if some else (lambda a: (1.0, 0.0, 0.0, 0.0))
    exponent, budget = solve(at, some, target_entropy, repetition, budget)
    weight = F.when(F.col("t") > 0, F.exp(F.lit(exponent) * F.log(F.col("t") / F.lit(max(total, 1)))) / F.lit(at(exponent)[0])).otherwise(0.0)
    mine = F.floor(F.lit(float(budget)) * weight * (1 + 1e-12)).cast("bigint")
    sources = sums.select("source", F.col("t").alias("source_tokens"), weight.alias("weight"), mine.alias("token_budget")).select(
        "*", F.expr("if(source_tokens > 0, token_budget div source_tokens, 1)").alias("passes"), F.expr("if(source_tokens > 0, token_budget % source_tokens, 0)").alias("rest")
    )
    sources = settle(sources)
    bits = max(0, math.ceil(math.log2(max(1, n / BLOCK_DOCS))))
    # Where the remainder of a source ends: the block, then the smaller block in it, and how many tokens are left of it there.
    ends, upto = sources.select("source", F.lit(0).cast("bigint").alias("block"), F.col("rest").alias("left")), Window.partitionBy("source").orderBy("block")
    known = 0

    def inside() -> DataFrame:
        there = ends.select(F.col("source").alias("s"), F.col("block").alias("b"), "left")
        return rows.join(small(there), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", 63 - known) == F.col("b"))).select("source", "place", "n_tokens", "left")

    for upper in sorted({bits // 2, bits}):
        blocks = inside().groupBy("source", "left", F.shiftright("place", 63 - upper).alias("block")).agg(F.sum("n_tokens").alias("t"))
        last = blocks.withColumn("end", F.sum("t").over(upto)).where("end > left and end - t <= left")
        ends = settle(last.groupBy("source").agg(F.min(F.struct("block", (F.col("left") - F.col("end") + F.col("t")).alias("left"))).alias("x")).select("source", "x.block", "x.left"))
        known = upper
    before = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = inside().withColumn("end", F.sum("n_tokens").over(before)).where("end > left").groupBy("source").agg(F.min("place").alias("cut"))
    found = sources.alias("s").join(small(cuts).alias("c"), F.expr("s.source <=> c.source"), "left")
    return settle(found.select("s.source", "source_tokens", "weight", "token_budget", "passes", F.coalesce("cut", F.lit(0)).cast("bigint").alias("cut"))), few


def mix_plan(
    docs: DataFrame, target_entropy: float | None = None, repetition: float | None = None, budget: int | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    tokens: Column | None = None, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, weight, source_tokens, token_budget and copies (0: left out).

    n_tokens: `tokens`, an expression over docs, or else the number of ids that the byte-level BPE of `path` gives the text;
    null counts as none. A null source is a source of its own; documents with equal ids share their place in the
    permutation. An empty table gives an empty result. Other columns are not read.
    """
    rows = counted(docs, tokens, seed, id_col, text_col, source_col, path, pattern)
    table, few = plan(rows, target_entropy, repetition, budget)
    return rows.alias("d").join((F.broadcast(table) if few else table).alias("p"), F.expr("d.source <=> p.source")).select(
        "doc_id", "d.source", "n_tokens", "weight", "source_tokens", "token_budget", (F.col("passes") + (F.col("place") < F.col("cut")).cast("bigint")).alias("copies")
    )


def mix(
    docs: DataFrame, target_entropy: float | None = None, repetition: float | None = None, budget: int | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    tokens: Column | None = None, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """The mixture itself: the rows of docs, each as often as its copies in mix_plan, with the columns of docs. Nothing is shuffled but sums (and documents by source, if there are over FEW_SOURCES)."""
    rows = counted(docs, tokens, seed, id_col, text_col, source_col, path, pattern).select("source", "n_tokens", "place")
    table, few = plan(rows, target_entropy, repetition, budget)
    s, passes, cut, copies, copy = (free_prefix(docs) + x for x in ("source", "passes", "cut", "copies", "copy"))
    table = table.select(F.col("source").alias(s), F.col("passes").alias(passes), F.col("cut").alias(cut))
    mixed = docs.join(F.broadcast(table) if few else table, docs[source_col].eqNullSafe(F.col(s)))
    mixed = mixed.withColumn(copies, (F.col(passes) + (permuted(id_col, seed) < F.col(cut)).cast("bigint")).cast("int")).where(F.col(copies) > 0)
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(*docs.columns)
