"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A document has one latent score w.x over hashed text features (presence of each word, and a few rates: shouting,
symbol runs, separators, repeated neighbours, share of distinct words), the same for all grades; ordered thresholds
t0 < t1 < ... cut it into grades: P(grade <= j) = logistic(t_j - w.x). So one set of weights gives the expected
grade and every tail probability P(grade >= j), and documents are selected by a tail.

The model is fitted on the driver to at most TRAIN_ROWS labelled documents, the first by a hash of their id, and of these
to as many as have TRAIN_FEATURES features together (fixed, documented bounds: what comes to the driver does not
grow with the table or with the length of texts); their features are made on the executors. Scoring is one pass
without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.llm.common import arrow_map, free_prefix, settle

TRAIN_ROWS, TRAIN_FEATURES, BUCKETS, RATES, MEMORY, STEP = 12_000, 24_000_000, 1 << 18, 6, 120_000, 1000
#: A word feature counts if it is in as many training documents at least.
LEAST_DOCS = 8
RESULTS = ("score", "expected_grade", "p_tail", "keep")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"[^\w\s]{2}")
_CORE = re.compile(r"\w+")


class _Codes(dict):
    """Of a word: hash buckets of its letters and of its stems (the first four and five letters), 18 bits each, and above them
    flags for shouting, symbol runs and bare separators."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        core = "".join(_CORE.findall(word.lower()))
        shout = len(core) > 1 and word.isupper()
        buckets = [xxhash.xxh32_intdigest(x.encode(), k) % BUCKETS for k, x in enumerate((core, core[:4], core[:5]))]
        self[word] = code = buckets[0] | buckets[1] << 18 | buckets[2] << 36 | shout << 54 | bool(_RUN.search(word)) << 55 | (not core) << 56
        return code


def features(text: str | None, codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words that occur, and the rates."""
    words = _WORD.findall(text or "")
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(RATES)
    code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    bucket = code & (BUCKETS - 1)
    unique = np.unique(code)
    distinct = np.unique(np.concatenate([unique >> s & (BUCKETS - 1) for s in (0, 18, 36)]))
    shout, run, bare = ((code >> s & 1).mean() for s in (54, 55, 56))
    again = (bucket[1:] == bucket[:-1]).mean() if n > 1 else 0.0
    return distinct, np.array([shout, run, bare, again, max(0.0, 0.5 - len(unique) / n) if n > 30 else 0.0, float(n < 5)])


@dataclass
class OrdinalModel:
    weights: np.ndarray  # of the buckets
    rates: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j from 1, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(cols: np.ndarray, lengths: np.ndarray, rates: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = 150, rate: float = 0.1, lasso: float = 1e-3) -> OrdinalModel:
    """Maximum likelihood with an absolute-value penalty on word weights (few words matter), by proximal Adam over all rows. The gaps between thresholds stay positive as exponentials.

    cols: the buckets of all rows one after another, lengths: how many each row has. Rows are taken STEP at a time, so beside cols
    itself a few arrays of STEP rows' buckets are in memory.
    """
    neutral = OrdinalModel(np.zeros(BUCKETS), np.zeros(RATES), np.zeros(n_grades - 1))
    if len(set(grades.tolist())) < 2:
        return neutral
    n = len(lengths)
    seen = np.zeros(BUCKETS, np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    spans = [(a, min(a + STEP, n)) for a in range(0, n, STEP)]
    for a, b in spans:
        seen += np.bincount(cols[ends[a] : ends[b]], minlength=BUCKETS)
    used = np.flatnonzero(seen >= LEAST_DOCS)
    place = np.full(BUCKETS, len(used), np.int32)  # one past the end: a weight that stays 0
    place[used] = np.arange(len(used))
    cols = place[cols]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(n_grades - 1) * 1e-2)
    x = np.concatenate([np.zeros(len(used) + RATES), start[:1], np.log(np.diff(start) + 1e-2)])
    m, v, w_end, each = np.zeros_like(x), np.zeros_like(x), len(used), np.arange(n)
    for step in range(1, rounds + 1):
        w, d, raw = np.append(x[:w_end], 0.0), x[w_end : w_end + RATES], x[w_end + RATES :]
        gaps = np.exp(np.clip(raw[1:], -8, 8))
        cuts = np.concatenate([raw[:1], raw[0] + np.cumsum(gaps)])
        score = rates @ d
        for a, b in spans:
            score[a:b] += np.bincount(np.repeat(np.arange(b - a), lengths[a:b]), weights=w[cols[ends[a] : ends[b]]], minlength=b - a)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -60, 60)))
        full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        p = np.maximum(full[each, grades + 1] - full[each, grades], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))], axis=1)
        up, down = slope[each, grades + 1] / p, slope[each, grades] / p
        by_score = (up - down) / n
        by_cut = np.zeros((n, n_grades + 1))
        by_cut[each, grades + 1] -= up
        by_cut[each, grades] += down
        tail = np.cumsum(by_cut[:, 1:-1].sum(axis=0)[::-1] / n)[::-1]
        by_word = np.zeros(w_end + 1)
        for a, b in spans:
            by_word += np.bincount(cols[ends[a] : ends[b]], weights=np.repeat(by_score[a:b], lengths[a:b]), minlength=w_end + 1)
        grad = np.concatenate([by_word[:w_end], rates.T @ by_score, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        x = x - scale * (m / (1 - 0.9**step))
        x[:w_end] = np.sign(x[:w_end]) * np.maximum(np.abs(x[:w_end]) - lasso * scale[:w_end], 0)
    weights = np.zeros(BUCKETS)
    weights[used] = x[:w_end]
    raw = x[w_end + RATES :]
    return OrdinalModel(weights, x[w_end : w_end + RATES], np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(np.clip(raw[1:], -8, 8)))]))


def train(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int = 3, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS, most: int = TRAIN_FEATURES) -> OrdinalModel:
    """A model from labelled documents. grade: an expression over labels, 0 to n_grades - 1; rows where it is null, or whose document is missing, are left out.

    An id with several labels has the least of them; of several documents with one id, that of the least hash counts.
    """
    drawn = (
        labels.select(F.col(id_col).alias("__id"), grade.cast("int").alias("__grade")).where("__id is not null and __grade is not null")
        .groupBy("__id").agg(F.min("__grade").alias("__grade")).orderBy(F.xxhash64("__id"), "__id").limit(limit)
    )
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    mine = texts.join(F.broadcast(drawn), F.col("__doc") == F.col("__id")).select("__grade", "text", F.xxhash64("__id").alias("place"), F.xxhash64("text").alias("pick"))  # limit rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            made = [features(t, codes) for t in batch.column(1).to_pylist()]
            ids = pa.array([b.astype(np.int32) for b, _ in made], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), ids, pa.array([r for _, r in made], pa.list_(pa.float64()))], ["grade", "place", "pick", "ids", "rates"])

    made = arrow_map(mine, run, "grade int, place bigint, pick bigint, ids array<int>, rates array<double>")
    once = settle(made.groupBy("place").agg(F.min_by(F.struct("grade", "ids", "rates"), "pick").alias("x")).select("place", "x.*"))
    sizes = sorted((r["place"], r["n"]) for r in once.select("place", F.size("ids").alias("n")).collect())  # limit rows
    upto = np.cumsum([n for _, n in sizes])
    fits = int(np.searchsorted(upto, most, side="right"))
    got = (once if fits == len(sizes) else once.where(F.col("place") < sizes[fits][0])).orderBy("place").select("grade", "ids", "rates").toArrow().combine_chunks()
    if not got.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, RATES)), np.zeros(0, np.int64), n_grades)
    ids = pa.concat_arrays(got["ids"].chunks)
    lengths, cols = ids.value_lengths().to_numpy().astype(np.int64), ids.flatten().to_numpy()
    rates = pa.concat_arrays(got["rates"].chunks).flatten().to_numpy().reshape(-1, RATES)
    return fit(cols, lengths, rates, got["grade"].to_numpy().astype(np.int64), n_grades)


def score(docs: DataFrame, model: OrdinalModel, cut: float = 0.6, text_col: str = "text") -> DataFrame:
    """docs with score, expected_grade, p_tail (the chance of the highest grade) and keep (p_tail >= cut).

    A null text is empty; a text without words is scored by its rates only. All rows and columns stay; columns named
    like a result column are replaced. A model that was fitted on fewer than two grades rejects nothing.
    """
    new = RESULTS
    mine = docs.select(*(c for c in docs.columns if c.lower() not in new))
    at = mine.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, m = _Codes(), sent.value
        neutral = not m.thresholds.any() and not m.weights.any()
        for batch in batches:
            made = [features(t, codes) for t in batch.column(at).to_pylist()]
            scores = np.array([m.weights[b].sum() + r @ m.rates for b, r in made])
            tails = m.tails(scores)
            keep = np.ones(len(scores), bool) if neutral else tails[:, -1] >= cut
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(keep)], [*batch.schema.names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mine.schema.fields)
    return arrow_map(mine, run, f"{schema}, score double, expected_grade double, p_tail double, keep boolean")


def select(docs: DataFrame, model: OrdinalModel, cut: float = 0.6, text_col: str = "text") -> DataFrame:
    """The rows of docs that score() keeps, with the columns of docs (those named like a result of score as well)."""
    own = free_prefix(docs)
    safe = {c: own + c if c.lower() in RESULTS else c for c in docs.columns}
    return score(docs.withColumnsRenamed(safe), model, cut, safe[text_col]).where("keep").select(*(F.col(name).alias(c) for c, name in safe.items()))


def grade_of_labels() -> Column:
    """Ratings of the labels table: 0 poor, 1 sound but toxic, 2 clean."""
    return F.expr("CASE WHEN quality = 0 THEN 0 WHEN quality = 1 AND toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 2 END")
