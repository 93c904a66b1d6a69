"""Token-ID output in training order.

Documents are encoded, ended by an end token, and cut into sequences of a fixed length (the last one padded). Sequences
are numbered without gaps, task after task, and a keyed Feistel permutation of that range, with cycle-walking, gives
each its global slot: the training order, which needs no sort of a random key, no table, and can be inverted. Slots are
range-partitioned into shards; each is one file of records of equal stride in slot order, so slot s is at byte
(s mod shard_slots) * stride of shard s div shard_slots, and reading can stop and resume anywhere. Encoded documents
are written once; shards are made from them in a few rounds, so that only a part of the records is shuffled at a time.

A record is `length` little-endian 16-bit ids, then the two bytes TAIL; Spark's own writer puts the bytes out, so a
shard is committed whole or not at all, wherever the output lies.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm.common import arrow_map, settle

TAIL, PAD, ROUNDS = "\x00\n", 65535, 6
#: Rounds in which shards are written, and records of an Arrow batch.
ROUNDS_OF_SHARDS, RECORDS = 4, 4096


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ np.uint64(key)) * np.uint64(factor)
        x ^= x >> np.uint64(29)
    return x ^ (x >> np.uint64(32))


class Permutation:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.keys = [(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64) for r in range(ROUNDS)]

    def _network(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in keys:
            if back:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        return left << half | right

    def _walk(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        x = self._network(np.asarray(x, np.uint64), keys, back)
        while len(out := np.flatnonzero(x >= self.n)):  # the range is at most four times n: two steps on average, four at worst expected
            x[out] = self._network(x[out], keys, back)
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def sequences(docs: DataFrame, path: str, pattern: str, length: int, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (with the end token), ids (16-bit, little-endian), part (the task that wrote the row) and before (sequences of
    the task's earlier rows), written once: whoever reads the rows, and in what pieces, finds the same numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoding(path, pattern).encode_ordinary, 0
        for batch in batches:
            ids = [array("H", [*encode(t or ""), end]) for t in batch.column(1).to_pylist()]
            n = np.array([len(i) for i in ids], np.int32)
            if sys.byteorder == "big":
                for i in ids:
                    i.byteswap()
            each = -(-n.astype(np.int64) // length)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(before + np.cumsum(each) - each)], ["doc_id", "n_tokens", "ids", "before"])
            before += int(each.sum())

    made = arrow_map(docs.select(F.col(id_col).cast("bigint"), text_col), run, "doc_id bigint, n_tokens int, ids binary, before bigint")
    return settle(made.withColumn("part", F.spark_partition_id()), compression="zstd")


@dataclass
class Numbering:
    """What a task must know to place sequences."""

    starts: dict[int, int]  # number of the first sequence of each written part
    total: int
    length: int
    key: int
    shard_slots: int

    def slots(self, n: np.ndarray, before: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each sequence of a batch of documents: its row, its place in the document, its slot."""
        each = -(-n.astype(np.int64) // self.length)
        row = np.repeat(np.arange(len(n)), each)
        seq = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        first = np.array([self.starts[p] for p in part.tolist()], np.int64) + before
        return row, seq, Permutation(self.total, self.key).slot(first[row] + seq)


@dataclass
class TrainingOrder:
    """Encoded documents and the order of their sequences."""

    rows: DataFrame
    numbering: Numbering

    @property
    def n_shards(self) -> int:
        return -(-self.numbering.total // self.numbering.shard_slots)

    def places(self) -> DataFrame:
        """slot, shard, offset (in bytes), doc_id, seq (of the document) and n_tokens (without padding) of every sequence."""
        numbering, length, shard_slots = self.numbering, self.numbering.length, self.numbering.shard_slots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, before, part = (batch.column(i).to_numpy() for i in (1, 2, 3))
                row, seq, slot = numbering.slots(n, before, part)
                filled = np.minimum(n[row] - seq * length, length).astype(np.int32)
                made = [pa.array(slot), pa.array((slot // shard_slots).astype(np.int32)), pa.array(slot % shard_slots * (2 * length + len(TAIL))), batch.column(0).take(pa.array(row)), pa.array(seq), pa.array(filled)]
                yield pa.RecordBatch.from_arrays(made, ["slot", "shard", "offset", "doc_id", "seq", "n_tokens"])

        return self._over(run, ["doc_id", "n_tokens", "before", "part"], "slot bigint, shard int, offset bigint, doc_id bigint, seq bigint, n_tokens int")

    def records(self, first: int, last: int) -> DataFrame:
        """slot and record of the sequences in shards first .. last - 1, a partition for each shard, in slot order."""
        numbering, length, shard_slots = self.numbering, self.numbering.length, self.numbering.shard_slots
        low, high = first * shard_slots, last * shard_slots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, seq, slot = numbering.slots(*(batch.column(i).to_numpy() for i in (1, 2, 3)))
                mine = np.flatnonzero((slot >= low) & (slot < high))
                for a in range(0, len(mine), RECORDS):
                    some = mine[a : a + RECORDS]
                    cut = [batch.column(0)[r].as_buffer()[2 * length * q : 2 * length * (q + 1)].to_pybytes().ljust(2 * length, b"\xff") for r, q in zip(row[some].tolist(), seq[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(slot[some]), pa.array((slot[some] // shard_slots - first).astype(np.int32)), pa.array(cut, pa.binary())], ["slot", "at", "record"])

        placed = self._over(run, ["ids", "n_tokens", "before", "part"], "slot bigint, at int, record binary")
        return placed.repartitionById(max(1, last - first), "at").sortWithinPartitions("slot").select("slot", "record")

    def _over(self, run, columns: list[str], schema: str) -> DataFrame:
        return arrow_map(self.rows.select(*columns), run, schema)


def training_order(docs: DataFrame, path: str, pattern: str, length: int = 512, end: int = 50256, key: int = 1, shard_slots: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> TrainingOrder:
    """Every sequence's place in the training order.

    A null text is empty and has one sequence, of the end token alone. Repeated rows and null ids are documents like any
    other. An empty table gives an empty order. Other columns are not read. Ids must fit 16 bits below PAD.
    """
    rows = sequences(docs, path, pattern, length, end, id_col, text_col)
    per_doc = F.ceil(F.col("n_tokens") / length).cast("bigint")
    counts = dict(rows.groupBy("part").agg(F.sum(per_doc).alias("n")).collect())  # a number for each task that wrote
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    return TrainingOrder(rows, Numbering(starts, total, length, key, shard_slots))


@contextmanager
def _short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that made them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_shards(order: TrainingOrder, out: str, rounds: int = ROUNDS_OF_SHARDS) -> None:
    """The records as raw files out/from-<first>/part-<i>-..., one for each shard first + i.

    A round writes consecutive shards; only its records are in a shuffle, so that the disk holds the documents' ids, the shards, and
    that share of the records at a time. A round that fails can be written again on its own.
    """
    n = order.n_shards
    step = max(1, -(-n // rounds))
    with _short_lived_shuffles(order.rows.sparkSession):
        for first in range(0, max(n, 1), step):
            records = order.records(first, min(first + step, n)).select(F.col("record").cast("string"))
            records.write.mode("overwrite").option("lineSep", TAIL).option("compression", "none").text(f"{out}/from-{first:08d}")


def read_slots(shard: bytes, length: int, first: int, count: int) -> np.ndarray:
    """Records first .. first + count - 1 of a shard's bytes; PAD fills the end of a document's last sequence."""
    stride = 2 * length + len(TAIL)
    raw = np.frombuffer(shard, np.uint8)[first * stride : (first + count) * stride].reshape(-1, stride)
    if not (raw[:, -2:] == np.frombuffer(TAIL.encode(), np.uint8)).all():
        raise ValueError("not a shard of this stride")
    return np.ascontiguousarray(raw[:, :-2]).view("<u2")


def read_shards(spark: SparkSession, out: str, length: int = 512, shard_slots: int = 16384) -> DataFrame:
    """slot and record_sha256 (32 bytes) of every record in the shards at out, as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                count, rest = divmod(len(raw), 2 * length + len(TAIL))
                if rest:
                    raise ValueError("not a shard of this stride")
                ids = read_slots(raw, length, 0, count)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(count) + shard * shard_slots), pa.array([hashlib.sha256(i).digest() for i in ids], pa.binary())], ["slot", "record_sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/from-*")
    number = lambda i: F.regexp_extract("path", r"from-(\d+)/part-(\d+)[^/]*$", i).cast("int")
    return files.select((number(1) + number(2)).alias("shard"), "content").mapInArrow(run, "slot bigint, record_sha256 binary")
