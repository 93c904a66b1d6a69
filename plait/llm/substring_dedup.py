"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark.

1. Documents are dealt into groups by a hash. A group hashes all its windows (rolling sums of word hashes times powers
   of an odd base, modulo 2^64) and sends each distinct hash once, so that even a passage of every document
   costs one entry a group. The hashes are sorted, cut by range, and packed as byte planes of their differences.
2. A range holds the entries of all groups. Sorted, a hash that two groups sent has an equal neighbour; it is
   sent back to these groups.
3. Each group meets its documents again (the exchange of step 1 is reused), hashes anew, and marks the windows whose
   hash came back or occurs twice in the group. Marked windows merge into maximal intervals; their words go.

Group and range sizes grow with the square root of the table only (so that a packed piece keeps some tens of hashes),
and hold no more of a hot passage than one entry. Two different windows are taken for equal with a chance of 2^-64 a
pair: 1e-3 for a collision anywhere among 10^8 windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.common import bounded_batches, fan_out
from plait.llm.simhash import WORDS

#: An odd base and its inverse modulo 2^64; words hashed at a time; word hashes remembered.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK, MEMORY = 1 << 19, 400_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def window_hashes(texts: list[list[bytes]], width: int, memo: _Hashes) -> Iterator[np.ndarray]:
    """For each text the hashes of its windows, by start."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (n == 0 or n + len(texts[end]) <= CHUNK):
            n += len(texts[end])
            end += 1
        words = np.fromiter((memo[w] for t in texts[at:end] for w in t), np.uint64, n)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=sums[1:])
        starts = max(0, n - width + 1)
        hashes = _mixed((sums[width : width + starts] - sums[:starts]) * down[:starts]) if starts else np.zeros(0, np.uint64)
        first = 0
        for t in texts[at:end]:
            yield hashes[first : first + max(0, len(t) - width + 1)]
            first += len(t)
        at = end


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted 64-bit integers as byte planes of their differences: planes of zeros compress away."""
    return np.diff(sorted_hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _words(texts: pa.ChunkedArray) -> list[list[bytes]]:
    return [WORDS.findall(t.encode()) if t else [] for t in texts.to_pylist()]


def _send(group: pa.Table, width: int, ranges: int) -> pa.Table:
    hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *window_hashes(_words(group["text"]), width, _Hashes())]))
    which = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.concatenate([np.flatnonzero(np.diff(which, prepend=np.uint64(ranges))), [len(hashes)]]).astype(np.int64)
    return pa.table(
        {
            "range": pa.array(which[cuts[:-1]].astype(np.int32)),
            "grp": pa.array([group["grp"][0].as_py()] * (len(cuts) - 1), pa.int64()),
            "packed": pa.array([pack(hashes[a:b]) for a, b in pairwise(cuts.tolist())], pa.binary()),
        }
    )


def _match(entries: pa.Table) -> pa.Table:
    """Of the hashes in a range, those that at least two groups sent, back to each of them."""
    parts = [unpack(p) for p in entries["packed"].to_pylist()]
    lengths = np.array([len(p) for p in parts])
    hashes, sender = np.concatenate(parts), np.repeat(np.arange(len(parts)), lengths)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = np.zeros(len(ordered) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    again = np.zeros(len(hashes), bool)
    again[order] = same[1:] | same[:-1]
    at = np.concatenate([[0], np.cumsum(lengths)])
    back = [(g, pack(p[again[a : a + len(p)]])) for g, p, a in zip(entries["grp"].to_pylist(), parts, at, strict=False)]
    back = [(g, p) for g, p in back if p]
    return pa.table({"grp": pa.array([g for g, _ in back], pa.int64()), "packed": pa.array([p for _, p in back], pa.binary())})


def _cut(group: pa.Table, back: pa.Table, width: int) -> pa.Table:
    if not group.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "spans": pa.array([], SPANS), "kept": pa.array([], pa.string())})
    texts = _words(group["text"])
    hashes = list(window_hashes(texts, width, _Hashes()))
    own = np.sort(np.concatenate(hashes))
    repeated = np.unique(np.concatenate([own[1:][own[1:] == own[:-1]], *(unpack(p) for p in back["packed"].to_pylist())]))
    removed, spans, kept = [], [], []
    for words, found in zip(texts, hashes, strict=True):
        if len(found) and len(repeated):
            place = np.minimum(np.searchsorted(repeated, found), len(repeated) - 1)
            marks = np.flatnonzero(repeated[place] == found)
        else:
            marks = np.zeros(0, np.int64)
        if not len(marks):
            removed.append(0)
            spans.append([])
            kept.append(b" ".join(words))
            continue
        new = np.flatnonzero(np.diff(marks) > width)  # marks further apart leave a word between their windows
        starts, ends = marks[np.concatenate([[0], new + 1])], marks[np.concatenate([new, [len(marks) - 1]])] + width
        removed.append(int((ends - starts).sum()))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
        edges = [0, *(int(x) for ab in zip(starts, ends, strict=True) for x in ab), len(words)]
        kept.append(b" ".join([w for i in range(0, len(edges), 2) for w in words[edges[i] : edges[i + 1]]]))
    return pa.table(
        {
            "doc_id": group["doc_id"],
            "n_words": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, SPANS),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def substring_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word intervals, from start to before end) and kept (the text left).

    A word goes if a window of `width` words of its document that covers it also starts anywhere else, in any document
    (judged on the input; all occurrences go). Kept words are joined by one space. A null text has no words; texts
    under `width` words are kept whole. Repeated rows, and rows with null ids, are documents like any other (and
    repeat each other). An empty table gives an empty result. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.count()
    root = math.isqrt(rows)
    n = fan_out(docs.sparkSession)
    groups, ranges = max(n, rows // max(512, root // 4)), max(n, rows // max(2048, root // 2))
    dealt = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    sent = dealt.groupBy("grp").applyInArrow(lambda t: _send(t, width, ranges), "range int, grp bigint, packed binary")
    back = sent.groupBy("range").applyInArrow(_match, "grp bigint, packed binary")
    return (
        dealt.groupBy("grp")
        .cogroup(back.groupBy("grp"))
        .applyInArrow(lambda left, right: _cut(left, right, width), "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept string")
    )
