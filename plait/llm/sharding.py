"""Sharding indivisible groups by Karmarkar-Karp differencing.

Rows of equal text form a group that no shard boundary may cut. Spark sums the groups. Those that hold a HEAVY-th of all
bytes or more (HEAVY at most, by counting) are differenced on the driver: again and again the two partial partitions of the
largest spread are combined in opposite order, until one is left. All others are dealt to tasks, and each task differences
its own, the largest first, CHUNK at a time, together with a partial partition: at first its share of the heavy
groups' sums, then what the chunk before it left. So every group is placed by the method, and groups of all tasks
make up for what a hot text does to one shard. A partial partition has a sum for each shard, and combining keeps its
shards apart; so the tasks' results need no further step to fit together. Documents get their shard by a join on the
group, of two written tables, so that adaptive execution can split a hot text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.common import arrow_map, fan_out, settle

#: The share of all bytes from which a group is heavy, groups of one heap, and groups that a task gets, about (some 30 bytes of memory each).
HEAVY, CHUNK, TASK_GROUPS = 4096, 4096, 1_000_000


def combined(parts: Sequence[Sequence[int]]) -> tuple[list[int], list[list[int]]]:
    """All partial partitions as one, and for each of them what its shards become.

    A partial partition is a list of sums, a shard each, from large to small; so is the result.
    """
    heap = [(part[-1] - part[0], i, list(part)) for i, part in enumerate(parts)]
    heapq.heapify(heap)
    into: list[tuple[int, list[int]] | None] = [None] * len(parts)  # the partition that one went into, and its shards' places there
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, k, b = heapq.heappop(heap)
        joined = [x + y for x, y in zip(a, reversed(b), strict=True)]
        order = sorted(range(len(joined)), key=lambda j: -joined[j])
        place = [0] * len(joined)
        for at, j in enumerate(order):
            place[j] = at
        sums = [joined[j] for j in order]
        into[i], into[k] = (len(into), place), (len(into), place[::-1])
        heapq.heappush(heap, (sums[-1] - sums[0], len(into), sums))
        into.append(None)
    final: list[list[int]] = [list(range(len(parts[0])))] * len(into)
    for i in range(len(into) - 2, -1, -1):
        up, place = into[i]
        final[i] = [final[up][j] for j in place]
    return heap[0][2], final[: len(parts)]


def place_groups(sizes: np.ndarray, given: Sequence[int]) -> tuple[list[int], np.ndarray]:
    """The sums of the shards with these groups, and the shard of each group. given: the sums before."""
    order = np.argsort(-sizes, kind="stable")
    names = sorted(range(len(given)), key=lambda j: -given[j])  # the shard at each place of the partial partition
    sums, placed = [given[j] for j in names], np.empty(len(sizes), np.int64)
    for i in range(0, len(order), CHUNK):
        mine = order[i : i + CHUNK]
        sums, places = combined([sums, *([n] + [0] * (len(given) - 1) for n in sizes[mine].tolist())])
        moved = [0] * len(given)
        for name, place in zip(names, places[0], strict=True):
            moved[place] = name
        names = moved
        placed[mine] = [names[where[0]] for where in places[1:]]
    return [n for _, n in sorted(zip(names, sums, strict=True))], placed


def differencing(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each item."""
    return place_groups(np.array(sizes, np.int64), [0] * shards)[1].tolist()


def shards_of_groups(groups: DataFrame, shards: int) -> DataFrame:
    """__key and shard for groups (__key, __sum)."""
    groups = settle(groups)
    spark, (total, n) = groups.sparkSession, groups.agg(F.coalesce(F.sum("__sum"), F.lit(0)), F.count(F.lit(1))).first()
    is_heavy = F.col("__sum") * HEAVY >= total
    heavy = sorted((tuple(r) for r in groups.where(is_heavy).select("__key", "__sum").collect()), key=lambda r: (-r[1], r[0]))
    sums, where = place_groups(np.array([size for _, size in heavy], np.int64), [0] * shards)
    light = total - sum(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            keys, sizes = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(2))
            mine = int(sizes.sum())
            placed = place_groups(sizes, [x * mine // light for x in sums])[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(placed.astype(np.int32))], ["__key", "shard"])

    dealt = groups.where(~is_heavy).repartition(max(fan_out(spark), -(-n // TASK_GROUPS)), "__key").select("__key", "__sum")
    known = spark.createDataFrame([(key, int(s)) for (key, _), s in zip(heavy, where, strict=True)], "__key bigint, shard int")
    return arrow_map(dealt, run, "__key bigint, shard int").unionByName(known)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null under this law) for every row.

    Rows of equal text share a shard. size is the text's UTF-8 bytes plus one; a null text is empty and belongs to the
    group of empty texts. slot counts a shard's rows without gaps from 0. Repeated rows and null ids are rows like any
    other. An empty table gives an empty result. Other columns are not read. (Texts whose 64-bit hashes are equal
    would share a shard as well, which breaks no rule.)
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("__key"),
        ).withColumn("__part", F.spark_partition_id())
    )
    places = settle(shards_of_groups(rows.groupBy("__key").agg(F.sum("size").alias("__sum")), shards))
    dealt = settle(rows.join(places.hint("merge"), "__key").select("doc_id", "size", "text_crc32", "__part", "shard"))
    # Slots: each written partition numbers its own rows of a shard, from where the partitions before it end.
    counts = dealt.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("shard", "__part").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("__at", F.row_number().over(own) - 1)
    return numbered.join(starts, ["shard", "__part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__start") + F.col("__at")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
