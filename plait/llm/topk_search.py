"""Exact top-k inner-product search by a three-phase uniform threshold.

Each vector is cut into m slices, and for a query each slice orders the vectors by their partial score: m
score lists, held locally by every task for its own rows.

1. Every task gathers the k best entries of each of its lists and resolves the full scores of these alone. The k-th
   best of all of them is a score that at least k vectors reach: a safe cutoff for the query.
2. The cutoffs are broadcast. A vector whose full score reaches cutoff c has a list with an entry of c / m or more,
   so each list yields its entries from the uniform threshold c / m on; what is missing of a vector counts as the
   threshold, and a vector whose bound stays under c goes. A list whose entries cannot reach the threshold in a block
   of vectors, by the largest length of its slices there, is not computed for that block and query.
3. The remaining scores are resolved in full; those at or over c are ranked, ties by the smaller id.

The query set may grow with the table, so it is cut into blocks of QUERY_BLOCK vectors: only one block (a few MB,
whatever the table's size) is ever on the driver or broadcast. Tasks keep k entries for each query of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.common import arrow_map, settle

#: Queries of one broadcast block; score lists; queries and rows of one matrix product.
QUERY_BLOCK, LISTS, QUERY_STEP, ROW_STEP = 8192, 4, 512, 2048


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and integer vector of the rows that take part: neither null, all components present and finite."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")
    )


def _matrix(vectors: pa.ListArray, scale: float) -> np.ndarray:
    return np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1))


def _by_width(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and matrix of the vectors of each length."""
    ids, vectors = batch.column(0).to_numpy(), batch.column(1)
    widths = vectors.value_lengths().to_numpy()
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        for i in range(0, len(at), ROW_STEP):
            part = at[i : i + ROW_STEP]
            if width:
                yield ids[part], _matrix(vectors.take(pa.array(part)), scale)
            else:
                yield ids[part], np.zeros((len(part), 0))


def _largest(a: np.ndarray, b: np.ndarray) -> float:
    """A bound of all inner products; an error where they might not fit 64 bits."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most >= 2.0**62:
        raise ValueError("inner products of these vectors may not fit 64 bits")
    return most


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles while they hold every sum, else 64-bit integers."""
    most = _largest(a, b)
    return (a @ b.T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def _slices(width: int, lists: int) -> list[slice]:
    edges = np.linspace(0, width, max(1, min(lists, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class _Best:
    """The k best (score, then smaller id) of each query, as far as seen."""

    def __init__(self, k: int):
        self.k, self.rows, self.parts, self.held = k, [np.zeros(0, np.int64)] * 3, [], 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, ids, score))
            self.held += len(query)
            if self.held > 400_000 + 2 * len(self.rows[0]):
                self.done()

    def done(self) -> list[np.ndarray]:
        q, v, s = (np.concatenate([a, *(p[i] for p in self.parts)]) for i, a in enumerate(self.rows))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        self.rows, self.parts, self.held = [x[place < self.k] for x in (q, v, s)], [], 0
        return self.rows


def _gather(batches, block, k: int, lists: int, scale: float):
    """Phase 1: for each query the k best full scores among the k best entries of each local list."""
    best = _Best(k)
    for batch in batches:
        for ids, rows in _by_width(batch, scale):
            for q_ids, queries in block.get(rows.shape[1], ()):
                partial = [_product(queries[:, s], rows[:, s]) for s in _slices(rows.shape[1], lists)]
                own = q_ids[:, None] == ids[None, :]
                if len(ids) <= k + 1:
                    q, r = np.nonzero(~own)
                else:
                    pick = np.zeros(own.shape, bool)
                    for p in partial:
                        np.put_along_axis(pick, np.argpartition(p, -k - 1, axis=1)[:, -k - 1 :], True, axis=1)
                    q, r = np.nonzero(pick & ~own)
                best.add(q_ids[q], ids[r], sum(p[q, r] for p in partial))
    q, v, s = best.done()
    if len(q):
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])


def _resolve(batches, block, cutoffs, k: int, lists: int, scale: float):
    """Phases 2 and 3: entries from the uniform threshold on, bounded, then resolved in full."""
    best = _Best(k)
    for batch in batches:
        for ids, rows in _by_width(batch, scale):
            for q_ids, queries in block.get(rows.shape[1], ()):
                _largest(queries, rows)
                parts = _slices(rows.shape[1], lists)
                cut = np.array([cutoffs.get(int(q), np.iinfo(np.int64).min // 4) for q in q_ids])[:, None]
                least = -((-cut) // len(parts))  # c / m, up to the next integer
                # By the lengths of slices no entry of a list is over |q| * |r|.
                reach = [np.linalg.norm(queries[:, s], axis=1) * np.linalg.norm(rows[:, s], axis=1).max(initial=0) for s in parts]
                some = np.flatnonzero(np.logical_or.reduce([x * (1 + 1e-9) + 1 >= least[:, 0] for x in reach]))
                if not len(some):
                    continue
                asked, mine, cut, least = queries[some], q_ids[some], cut[some], least[some]
                partial = [_product(asked[:, s], rows[:, s]) for s in parts]
                sent = [p >= least for p in partial]
                bound = sum(np.where(there, p, least) for there, p in zip(sent, partial, strict=True))
                q, r = np.nonzero(np.logical_or.reduce(sent) & (bound >= cut) & (mine[:, None] != ids[None, :]))
                total = sum(p[q, r] for p in partial)
                good = total >= cut[q, 0]
                best.add(mine[q[good]], ids[r[good]], total[good])
    q, v, s = best.done()
    if len(q):
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])


_ROWS = "query_id bigint, vec_id bigint, score bigint"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Spark keeps k rows of each query before and after the shuffle (a group limit under the rank)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", lists: int = LISTS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for each row where is_query holds.

    Components count as floor(scale * x); the score is the integer inner product. Rows with a null id, a null
    vector, or a null or non-finite component take no part; vectors are compared with those of their own length
    only (an empty vector scores 0). Fewer than k other rows: all of them. Rows that repeat an id are each a
    candidate, but a query never finds its own id, and of repeated query ids the smallest vector is asked. Finite components
    so large that a score might not fit 64 bits are an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    asked = settle(usable(vectors.where(is_query), id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = []
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        block: dict[int, list] = {}
        for batch in mine.toArrow().to_batches():
            for ids, matrix in _by_width(batch, scale):
                for i in range(0, len(ids), QUERY_STEP):
                    block.setdefault(matrix.shape[1], []).append((ids[i : i + QUERY_STEP], matrix[i : i + QUERY_STEP]))
        sent = spark.sparkContext.broadcast(block)
        lists_of = arrow_map(rows, lambda it, sent=sent: _gather(it, sent.value, k, lists, scale), _ROWS)
        near = _ranked(lists_of, k).where(F.col("rank") == k).select("query_id", "score")
        cutoffs = spark.sparkContext.broadcast({r[0]: r[1] for r in near.toArrow().to_pandas().itertuples(index=False)})
        part = arrow_map(rows, lambda it, sent=sent, cutoffs=cutoffs: _resolve(it, sent.value, cutoffs.value, k, lists, scale), _ROWS)
        part = _ranked(part, k).select("query_id", "rank", "vec_id", "score")
        found.append(part if blocks == 1 else settle(part))
    return reduce(DataFrame.unionAll, found)



