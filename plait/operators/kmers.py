"""k-mers, minimizers, weighted minimizers and closed syncmers of sequences, and hit indexes over graphs.

Canonical k-mers are built-in expressions. Minimizer schemes need unsigned 64-bit hashes and sliding minima, which
are one vectorised pass over Arrow batches. Keys stay strings: their order and equality are those of packed keys.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.functions import dna
from plait.operators.graph import HapGraph
from plait.operators.paths import haplotype_ids, too_many_haplotypes
from plait.operators.windows import contexts, haplotype_windows, visits_of, walk_text, window_sequences
from plait.storage import settle

#: k-mers that may be listed in a minimizer scheme: 8 bytes each, sent to every task.
MOST_FREQUENT = 4_000_000


def canonical_kmers(seqs: DataFrame, k: int, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """id, kmer, is_rev, offset for every k-mer of A, C, G, T: the smaller strand; palindromes count as reverse. A reverse k-mer is at its last base."""
    n = F.length(seq_col) - k
    at = seqs.where(n >= 0).select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"), F.explode(F.sequence(F.lit(0), n)).alias("i"))
    cut = at.select("id", "i", F.upper(F.substring(F.col("seq"), F.col("i") + 1, F.lit(k))).alias("fwd")).where(F.col("fwd").rlike(f"^[ACGT]{{{k}}}$"))
    both = cut.withColumn("rev", F.reverse(F.translate("fwd", "ACGT", "TGCA")))
    is_rev = F.col("rev") <= F.col("fwd")
    return both.select("id", F.least("fwd", "rev").alias("kmer"), is_rev.alias("is_rev"), F.when(is_rev, F.col("i") + k - 1).otherwise(F.col("i")).alias("offset"))


_CODE = np.full(256, -1, np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


_BASES = np.frombuffer(b"ACGT", np.uint8)

#: A key in two 64-bit words: a k-mer of up to 63 bases.
Key = tuple[np.ndarray, np.ndarray]


class _Texts:
    """Texts as one array of base codes, each followed by a separator that no k-mer or window goes over."""

    def __init__(self, texts: Sequence[str]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = ("\n".join(texts) + "\n").encode("ascii", "replace")  # what is no base stays one letter
        self.code = _CODE[np.frombuffer(joined, np.uint8)]
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.text = np.repeat(np.arange(len(texts)), self.size + 1)
        self.left = np.repeat(self.start + self.size, self.size + 1) - np.arange(len(self.code))  # bases from here to the end of the text

    def strands(self, k: int) -> tuple[Key, Key, np.ndarray]:
        """Keys (high and low word) of the k-mers on both strands at each place, and which are valid."""
        code, n = self.code, max(0, len(self.code) - k + 1)
        zero = lambda: (np.zeros(n, np.uint64), np.zeros(n, np.uint64))
        fwd, rev, bad = zero(), zero(), np.concatenate([[0], np.cumsum(code < 0)])

        def push(key: Key, base: np.ndarray) -> Key:
            high, low = key
            if k > 32:
                high = high << np.uint64(2) | low >> np.uint64(62)
            return high, low << np.uint64(2) | (base & 3).astype(np.uint64)

        for j in range(k if n else 0):
            fwd, rev = push(fwd, code[j : j + n]), push(rev, 3 - code[k - 1 - j : k - 1 - j + n])
        return fwd, rev, bad[k : k + n] == bad[:n] if n else np.zeros(0, bool)

    def kmers(self, at: np.ndarray, is_rev: np.ndarray, k: int) -> pa.StringArray:
        """The k-mers at valid places, as they are read."""
        code = self.code[at[:, None] + np.arange(k)]
        code = np.where(is_rev[:, None], 3 - code[:, ::-1], code)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(_BASES[code].tobytes()))

    def offsets(self, at: np.ndarray, is_rev: np.ndarray, k: int) -> np.ndarray:
        """Place in the text, of a reverse k-mer that of its last base."""
        return at - self.start[self.text[at]] + is_rev * (k - 1)


def _plain_hash(key: Key, bits: int) -> np.ndarray:
    """Hash of a 64-bit key, or of a 128-bit one: the hashes of both words, combined."""
    if bits == 64:
        return dna.wang_hash(key[1])
    h = dna.wang_hash(key[0])
    with np.errstate(over="ignore"):
        return h ^ (dna.wang_hash(key[1]) + np.uint64(0x9E3779B9) + (h << np.uint64(6)) + (h >> np.uint64(2)))


def _hash(key: Key, frequent: Key | None, rounds: int, bits: int) -> np.ndarray:
    h = _plain_hash(key, bits)
    if frequent is None:
        return h
    often = np.isin(key[1], frequent[1])
    if often.any() and frequent[0].any() | key[0].any():
        both = set(zip(frequent[0].tolist(), frequent[1].tolist(), strict=True))
        at = np.flatnonzero(often)
        often[at] = [pair in both for pair in zip(key[0][at].tolist(), key[1][at].tolist(), strict=True)]
    return np.where(often, dna.downweight(h, rounds), h)


def _minimizers(texts: _Texts, k: int, w: int, frequent: Key | None = None, rounds: int = 0, bits: int = 64) -> tuple[np.ndarray, ...]:
    """place, forward and reverse hash, first and last window of the k-mers that attain the least hash of a full window of w.

    All ties within a window count; windows without a valid k-mer are skipped.
    """
    fwd, rev, valid = texts.strands(k)
    n = max(0, len(valid) - w + 1)
    hf, hr = (_hash(x, frequent, rounds, bits) for x in (fwd, rev))
    seen = np.where(valid, np.minimum(hf, hr), np.uint64(2**64 - 1))
    least = seen[:n].copy()
    for j in range(1, w):
        np.minimum(least, seen[j : j + n], out=least)
    full = texts.left[:n] >= k + w - 1
    first, last, window = np.full(len(valid), -1), np.full(len(valid), -1), np.arange(n)
    for j in reversed(range(w)):  # of a place the windows that it wins, first to last
        won = full & valid[j : j + n] & (seen[j : j + n] == least)
        last[j : j + n][won] = window[won]
        won &= first[j : j + n] < 0
        first[j : j + n][won] = window[won]
    at = np.flatnonzero(last >= 0)
    return at, hf[at], hr[at], first[at], last[at]


def minimizers_of(text: str, k: int, w: int, frequent: Key | None = None, rounds: int = 0, bits: int = 64) -> list[tuple[int, bool, int, int, int]]:
    """(start, is_rev, hash, first window, last window) of the minimizers of one text. The smaller strand by hash counts, a tie forwards."""
    at, hf, hr, first, last = _minimizers(_Texts([text]), k, w, frequent, rounds, bits)
    return list(zip(at.tolist(), (hr < hf).tolist(), np.minimum(hf, hr).tolist(), first.tolist(), last.tolist(), strict=True))


def _syncmers(texts: _Texts, k: int, s: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """place and is_rev of closed syncmers: the least s-mer hash of the k-mer is at its first or last s-mer."""
    fwd, rev, valid = texts.strands(k)
    sf, sr, _ = texts.strands(s)
    sh, n = np.minimum(_plain_hash(sf, bits), _plain_hash(sr, bits)), len(valid)
    least = sh[:n].copy()
    for j in range(1, k - s + 1):
        np.minimum(least, sh[j : j + n], out=least)
    at = np.flatnonzero(valid & ((sh[:n] == least) | (sh[k - s : k - s + n] == least)))
    hf, hr = (_plain_hash((high[at], low[at]), bits) for high, low in (fwd, rev))
    return at, hr < hf


def syncmers_of(text: str, k: int, s: int, bits: int = 64) -> list[tuple[int, bool]]:
    """(start, is_rev) of the closed syncmers of one text."""
    at, is_rev = _syncmers(_Texts([text]), k, s, bits)
    return list(zip(at.tolist(), is_rev.tolist(), strict=True))


#: The longest k-mers for keys of 64 and 128 bits.
MOST_BASES = {64: 31, 128: 63}


def check_parameters(k: int, w: int | None = None, s: int | None = None, bits: int = 64) -> int:
    """Bases of a window; parameters out of range are an error."""
    if not 2 <= k <= MOST_BASES[bits] or (w is not None and w < 1) or (s is not None and not 1 <= s < k):
        raise ValueError(f"k={k}, w={w}, s={s} out of range")
    return 2 * k - s - 1 if s is not None else k + (w or 1) - 1


_HIT = "id {0}, kmer string, is_rev boolean, offset int"


def _over(seqs: DataFrame, id_col: str, seq_col: str, k: int, f, extra: str = "") -> DataFrame:
    """f gives place, is_rev and further columns of the k-mers of a whole batch of texts."""
    kind = seqs.schema[id_col].dataType.simpleString()
    names = ["id", "kmer", "is_rev", "offset", *(e.split()[0] for e in extra.split(",") if e.strip())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pc.is_valid(batch.column(1))
            ids, texts = batch.column(0).filter(some), _Texts(batch.column(1).filter(some).to_pylist())
            at, is_rev, *more = f(texts)
            own = texts.text[at]
            columns = [ids.take(pa.array(own)), texts.kmers(at, is_rev, k), pa.array(is_rev), *(pa.array(x.astype(np.int32)) for x in (texts.offsets(at, is_rev, k), *(m(texts, own) for m in more)))]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if i == 1 else c for i, c in enumerate(columns)], names)

    return seqs.select(F.col(id_col).alias("id"), seq_col).mapInArrow(run, _HIT.format(kind) + extra)


_RC = str.maketrans("ACGT", "TGCA")


def _keys(kmers: Collection[str]) -> Key:
    whole = [int(x.upper().translate(str.maketrans("ACGT", "0123")), 4) for x in kmers]
    return np.array([x >> 64 for x in whole], np.uint64), np.array([x & (1 << 64) - 1 for x in whole], np.uint64)


def frequent_keys(kmers: DataFrame, most: int = MOST_FREQUENT) -> list[str]:
    """A column kmer of canonical k-mers, and their reverse complements, for minimizers(); over `most` of them are an error, as all go to every task."""
    found = [r["kmer"] for r in kmers.select("kmer").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} frequent k-mers: raise the threshold")
    return sorted({x for kmer in found for x in (kmer, kmer.translate(_RC)[::-1])})


def minimizers(seqs: DataFrame, k: int, w: int, frequent: Collection[str] = (), rounds: int = 0, id_col: str = "id", seq_col: str = "seq", bits: int = 64) -> DataFrame:
    """id, kmer, is_rev, offset, by hashes of 64- or 128-bit keys. frequent: k-mers whose hashes are downweighted in `rounds` (1 to 7) rounds; none or 0 rounds: unweighted."""
    check_parameters(k, w=w, bits=bits)
    if rounds > 7:
        raise ValueError("at most 7 rounds")
    some = _keys(frequent) if frequent and rounds else None

    def f(texts: _Texts) -> tuple:
        at, hf, hr, *_ = _minimizers(texts, k, w, some, rounds, bits)
        return at, hr < hf

    return _over(seqs, id_col, seq_col, k, f)


def minimizer_regions(seqs: DataFrame, k: int, w: int, id_col: str = "id", seq_col: str = "seq", bits: int = 64) -> DataFrame:
    """Minimizers with start and length of the run of windows that each wins."""
    check_parameters(k, w=w, bits=bits)

    def f(texts: _Texts) -> tuple:
        at, hf, hr, first, last = _minimizers(texts, k, w, bits=bits)
        return at, hr < hf, lambda t, own: first - t.start[own], lambda t, own: last - first + k + w - 1

    return _over(seqs, id_col, seq_col, k, f, ", start int, length int")


def syncmers(seqs: DataFrame, k: int, s: int, id_col: str = "id", seq_col: str = "seq", bits: int = 64) -> DataFrame:
    check_parameters(k, s=s, bits=bits)
    return _over(seqs, id_col, seq_col, k, lambda texts: _syncmers(texts, k, s, bits))


# Indexes: hits (kmer, node_id, is_rev, offset [, payload, hap_bits]).


def _on_nodes(graph: HapGraph, windows: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Hits at window offsets, as positions on nodes: kmer, node_id, is_rev, offset, and nodes, the walk that the k-mer covers."""
    nodes = windows.select(walk_text(F.col("nodes")).alias("id"), "nodes")
    ends = F.transform("nodes", lambda x, i: F.struct(x["node_id"].alias("node_id"), x["is_rev"].alias("is_rev"), x["len"].alias("len"), F.aggregate(F.slice("nodes", 1, i), F.lit(0).cast("bigint"), lambda a, y: a + y["len"]).alias("start")))
    placed = hits.join(nodes.select("id", ends.alias("nodes")), "id")
    at, first = F.col("offset"), F.when(F.col("is_rev"), F.col("offset") - k + 1).otherwise(F.col("offset"))
    cover = F.filter("nodes", lambda x: (x["start"] + x["len"] > first) & (x["start"] < first + k))
    mine = F.element_at(F.filter("nodes", lambda x: (x["start"] <= at) & (at < x["start"] + x["len"])), 1)
    found = placed.select("kmer", "is_rev", cover.alias("cover"), mine.alias("x"), "offset")
    inside = F.col("offset") - F.col("x.start")
    return found.select(
        "kmer",
        F.col("x.node_id").alias("node_id"),
        F.when(F.col("is_rev"), ~F.col("x.is_rev")).otherwise(F.col("x.is_rev")).alias("is_rev"),
        F.when(F.col("is_rev"), F.col("x.len") - 1 - inside).otherwise(inside).cast("int").alias("offset"),
        F.transform("cover", lambda x: F.struct(x["node_id"].alias("node_id"), x["is_rev"].alias("is_rev"), x["len"].alias("len"))).alias("nodes"),
    )


def _spell(key: Key, k: int) -> pa.Array:
    """Keys as k-mers."""
    word = lambda j: (key[0] if j > 31 else key[1]) >> np.uint64(2 * (j % 32)) & np.uint64(3)
    text = _BASES[np.stack([word(j) for j in reversed(range(k))], axis=1)] if len(key[1]) else np.zeros((0, k), np.uint8)
    return pa.StringArray.from_buffers(len(text), pa.py_buffer((np.arange(len(text) + 1) * k).astype(np.int32)), pa.py_buffer(text.tobytes()))


def _index(graph: HapGraph, k: int, around: int, scheme) -> DataFrame:
    """Distinct hits (kmer, node_id, is_rev, offset) on all paths. scheme picks k-mers (place, key or hash on both strands) in a batch of texts.

    A text is a node with `around` bases before and after it on a path, so a node has all its hits: those read forwards start in it, those
    read backwards end in it (of a tie between the strands, both count). Contexts come in order of nodes, and a hit is given once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # hits of the last node so far: node, is_rev, offset, key
        for batch in batches:
            node, left, seq, right = batch.columns
            texts = _Texts(pc.binary_join_element_wise(left, seq, right, "").to_pylist())
            before, size = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, seq))
            node = node.to_numpy(zero_copy_only=False)
            at, hf, hr = scheme(texts)[:3]
            fwd, rev, _ = texts.strands(k)
            found = []
            for is_rev, mine, key in ((False, hf <= hr, fwd), (True, hr <= hf, rev)):
                p = at[mine]
                own = texts.text[p]
                offset = p - texts.start[own] - before[own]
                offset = size[own] - 1 - (offset + k - 1) if is_rev else offset
                kept = (offset >= 0) & (offset < size[own])
                p, own, offset = p[kept], own[kept], offset[kept]
                found.append((node[own], np.full(len(p), is_rev), offset, key[0][p], key[1][p]))
            hits = [np.concatenate(x) for x in zip(*found, *([held] if held else []), strict=True)]
            order = np.lexsort(hits[::-1])
            hits = [x[order] for x in hits]
            new = np.zeros(len(order), bool)
            for x in hits:
                new[1:] |= x[1:] != x[:-1]
            new[:1] = True
            hits = [x[new] for x in hits]
            done = hits[0] != node[-1] if len(node) else np.ones(len(hits[0]), bool)
            held = tuple(x[~done] for x in hits)
            yield _hits(*(x[done] for x in hits))
        if held:
            yield _hits(*held)

    def _hits(node, is_rev, offset, high, low) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_spell((high, low), k), pa.array(node), pa.array(is_rev), pa.array(offset.astype(np.int32))], ["kmer", "node_id", "is_rev", "offset"])

    return contexts(graph, around).mapInArrow(run, "kmer string, node_id bigint, is_rev boolean, offset int")


def minimizer_index(graph: HapGraph, k: int, w: int, payload: DataFrame | None = None) -> DataFrame:
    """Distinct minimizer hits of all haplotype windows; payload (node_id, is_rev, offset, payload) is joined after the dedup."""
    index = _index(graph, k, check_parameters(k, w=w) - 1, lambda texts: _minimizers(texts, k, w))
    return index if payload is None else with_payload(index, payload)


def with_payload(index: DataFrame, payload: DataFrame) -> DataFrame:
    """index with the payload of each position (node_id, is_rev, offset, payload); a position has one payload, of several the least."""
    at = ["node_id", "is_rev", "offset"]
    return index.join(payload.groupBy(*at).agg(F.min("payload").alias("payload")), at, "left")


def minimizer_index_with_paths(graph: HapGraph, k: int, w: int) -> DataFrame:
    """Hits with hap_bits: bit i is set if haplotype i contains the walk that the k-mer covers there."""
    if too_many_haplotypes(graph.paths) and graph.steps.select("path_id").distinct().join(graph.paths, "path_id", "left_anti").limit(1).count() == 0:
        return minimizer_index(graph, k, w).withColumn("hap_bits", F.lit(1).cast("bigint"))  # all paths share one id, and some path has each hit
    windows = settle(haplotype_windows(graph, check_parameters(k, w=w)))
    hits = minimizers(window_sequences(graph, windows).withColumnRenamed("walk", "id"), k, w)
    placed = settle(_on_nodes(graph, windows, hits, k).distinct())
    walks = placed.select(walk_text(F.col("nodes")).alias("walk"), "nodes").distinct()  # one lookup for each distinct walk
    votes = visits_of(graph, walks)
    ids = haplotype_ids(graph.paths).select("path_id", "hap_id")
    bits = votes.select("walk", "path_id").distinct().join(ids, "path_id").groupBy("walk").agg(F.bit_or(F.expr("shiftleft(1L, hap_id)")).alias("hap_bits"))
    return placed.withColumn("walk", walk_text(F.col("nodes"))).join(bits, "walk").groupBy("kmer", "node_id", "is_rev", "offset").agg(F.bit_or("hap_bits").alias("hap_bits"))


def kmer_index(graph: HapGraph, k: int, include: Column | None = None) -> DataFrame:
    """Distinct canonical k-mer hits of the haplotype windows of k bases; include: a condition on kmer."""
    def scheme(texts: _Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fwd, rev, valid = texts.strands(k)
        at = np.flatnonzero(valid)
        (fh, fl), (rh, rl) = ((high[at], low[at]) for high, low in (fwd, rev))
        more, less = (fh > rh) | (fh == rh) & (fl > rl), (fh < rh) | (fh == rh) & (fl < rl)
        return at, more.astype(np.int8), less.astype(np.int8)

    index = _index(graph, k, check_parameters(k, bits=128) - 1, scheme)
    return index if include is None else index.where(include)


def by_middle_base(index: DataFrame, k: int) -> dict[str, DataFrame]:
    """Four indexes by the base at k / 2."""
    return {b: index.where(F.substring("kmer", k // 2 + 1, 1) == b) for b in "ACGT"}


def frequent_kmers(index: DataFrame, threshold: int) -> DataFrame:
    """k-mers with over `threshold` distinct hits, and the number."""
    return index.groupBy("kmer").agg(F.count(F.lit(1)).alias("n_hits")).where(F.col("n_hits") > threshold)


def hit_histogram(index: DataFrame) -> DataFrame:
    """n_hits and the number of k-mers with as many."""
    return index.groupBy("kmer").agg(F.count(F.lit(1)).alias("n_hits")).groupBy("n_hits").agg(F.count(F.lit(1)).alias("n_kmers"))


def index_statistics(index: DataFrame) -> DataFrame:
    return index.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_values"), F.sum((F.col("n") == 1).cast("bigint")).alias("n_unique")
    )


def add_hits(index: DataFrame, more: DataFrame) -> DataFrame:
    """Union of hits with hap_bits; equal positions of a k-mer are merged, their bits joined."""
    key = ["kmer", "node_id", "is_rev", "offset"]
    return index.unionByName(more).groupBy(*key).agg(F.bit_or("hap_bits").alias("hap_bits"))


def hits_in_subgraph(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits on the given nodes."""
    return index.join(nodes.select("node_id"), "node_id", "left_semi")


def same_index(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0
