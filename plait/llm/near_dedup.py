"""Near-dedup of texts by an exact prefix filter on their word shingles, with every link verified.

In one order of all shingles (those most texts have last), two sets of a Jaccard similarity of s or more have a
shingle in common among the first n - ceil(s * n) + 1 of each: with fewer, what is left could not make up the
similarity. These are the keys of a text. No pair is missed; a pair is dropped only where its counts, or the places
of a common key, leave too few shingles, and verified by the exact similarity of the sets. Equal sets are one node.

Runs of equal keys are the candidates, in two steps. First every text of a run meets the one that shares most of it
(the base of a group of copies), and the components of what is verified are taken. Then all pairs of a run that are
in different components are verified, in tiles of bounded size. So every pair that shares a key is linked, tried, or
linked by way of others; nothing falls before all links are known. Of linked texts the smallest id stays.

SimHashes, where asked for, link by their deletion-variant signatures as in op6, as well: texts that one of the two ways
links are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.llm.common import arrow_map, discard, fan_out, free_prefix, settle
from plait.llm.components import components
from plait.llm.simhash import links as fingerprint_links
from plait.llm.simhash import majority, shingle_hashes
from plait.llm.substring_dedup import pack, unpack

#: Shingles whose counts order the keys, shingles counted at a time, texts of a tile, slack of floats, and bits of a sketch.
COMMON, RANGE, TILE, SLACK, BITS = 1 << 18, 1 << 22, 1024, 1e-6, 1024


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts have, sorted, and in how many: of those in over two, as many of the most frequent as make COMMON at
    most. All shingles are counted, range by range. They decide the order of keys only, so how many are kept changes the work and not the result."""
    ranges = max(fan_out(sets.sparkSession), (sets.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0) // RANGE)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.unique(np.concatenate([_unpack(packed) for packed in batch.column(0).to_pylist()]), return_counts=True)
            which = (keys * np.uint64(ranges)) >> np.uint64(40)
            at = np.concatenate([np.flatnonzero(np.diff(which, prepend=np.uint64(ranges))), [len(keys)]]).tolist()
            packed = [_pack(keys[i:j]) for i, j in pairwise(at)]
            many = [counts[i:j].astype(np.uint16).tobytes() for i, j in pairwise(at)]  # a batch has fewer rows
            yield pa.RecordBatch.from_arrays([pa.array(which[at[:-1]].astype(np.int32)), pa.array(packed, pa.binary()), pa.array(many, pa.binary())], ["range", "keys", "counts"])

    def add(pieces: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack(packed) for packed in pieces["keys"].to_pylist()])
        counts = np.frombuffer(b"".join(pieces["counts"].to_pylist()), np.uint16)
        order = np.argsort(keys)
        first = np.flatnonzero(np.diff(keys[order], prepend=np.uint64(1 << 40)))
        keys, counts = keys[order][first], np.add.reduceat(counts[order].astype(np.int64), first)
        return pa.table({"key": keys[counts > 2].view(np.int64), "count": counts[counts > 2]})

    sent = arrow_map(sets.select("set"), send, "range int, keys binary, counts binary")
    found = settle(sent.groupBy("range").applyInArrow(add, "key bigint, count bigint"))
    least, left = 3, COMMON
    for r in found.groupBy("count").agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("count")).toLocalIterator():
        left -= r["keys"]
        if left < 0:
            least = r["count"] + 1
            break
    top = found.where(F.col("count") >= least).toArrow().sort_by("key")
    discard(found)
    return top["key"].to_numpy().astype(np.uint64), top["count"].to_numpy()


def prefixes(sets: DataFrame, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, rid, n, i): of each set the first n - ceil(similarity * n) + 1 shingles, rare ones first; i is the place of a key."""
    keys, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            most = np.minimum(n, n - np.ceil(similarity * n - SLACK).astype(n.dtype) + 1)
            made = []
            for packed, k in zip(batch.column(2).to_pylist(), most.tolist(), strict=True):
                s = _unpack(packed)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    s = s[np.argsort(np.where(keys[at] == s, counts[at], 0), kind="stable")]  # s is sorted: of equal counts the smaller first
                made.append(s[:k])
            of = np.repeat(np.arange(len(n)), most)
            i = np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64)), batch.column(0).take(pa.array(of)), pa.array(n[of], pa.int32()), pa.array(i, pa.int32())], ["key", "rid", "n", "i"])

    return arrow_map(sets.select("rid", "n", "set"), run, "key bigint, rid bigint, n int, i int")


def shared_keys(index: DataFrame) -> DataFrame:
    """The rows (key, rid, n, i) whose key two or more have; one sort by key, runs found as they stream by."""
    ordered = index.repartition(fan_out(index.sparkSession), "key").sortWithinPartitions("key", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = None, False  # the last row seen, and whether the one before has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            key = rows["key"].to_numpy()
            same = key[1:] == key[:-1]
            more = np.concatenate([same, [False]]) | np.concatenate([[joined], same])
            held, joined = rows.slice(len(key) - 1).to_batches()[0], bool(more[-1])
            yield from rows.slice(0, len(key) - 1).filter(pa.array(more[:-1])).to_batches()
        if joined:
            yield held

    return ordered.mapInArrow(run, "key bigint, rid bigint, n int, i int")


def _fit(similarity: float) -> Column:
    """Whether x and y, alike in a key at places x_i and y_i, can have the similarity: their first common key always passes."""
    share = F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i"))
    return (F.least("x_n", "y_n") >= similarity * F.greatest("x_n", "y_n") - SLACK) & ((1 + similarity) * share >= similarity * (F.col("x_n") + F.col("y_n")) - SLACK)


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select("key", *more, *(F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in ("key", *more)))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x_rid", "y_rid").alias("a"), F.greatest("x_rid", "y_rid").alias("b")).distinct()


def hub_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): in each run, every text with the one that shares most: linear in the number of rows."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weight = members.join(sizes, "key").groupBy("rid").agg(F.sum("size").alias("weight"))
    hubs = members.join(weight, "rid").groupBy("key").agg(F.max(F.struct("weight", "rid", "n", "i")).alias("hub")).select("key", "hub.rid", "hub.n", "hub.i")
    return _pairs(_side(members, "x").join(_side(hubs, "y"), "key").where((F.col("x_rid") != F.col("y_rid")) & _fit(similarity)))


def other_pairs(members: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of a run that are in different components (labels: node, root). The texts outside a run's largest component,
    in tiles of TILE or so, meet all of the run: what is linked already is not paired within itself."""
    known = members.join(labels, F.col("rid") == F.col("node"), "left").select(*members.columns, F.coalesce("root", "rid").alias("label"))
    kinds = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = kinds.groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    tiles = F.ceil((F.col("size") - F.col("most.c")) / TILE).cast("int")
    rows = settle(known.join(mixed.select("key", F.col("most.label").alias("big"), tiles.alias("tiles")), "key"))
    x = _side(rows.where("label <> big").withColumn("tile", F.expr("int(pmod(xxhash64(rid), tiles))")).drop("tiles"), "x", "tile")
    y = _side(rows.withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)"))).drop("tiles", "big"), "y", "tile")
    once = (F.col("y_label") == F.col("x_big")) | (F.col("x_label") < F.col("y_label"))
    return _pairs(x.join(y, ["key", "tile"]).where((F.col("x_label") != F.col("y_label")) & once & _fit(similarity)))


def _pack(shingles: np.ndarray) -> bytes:
    return pack(shingles)[: 5 * len(shingles)]  # the planes over 40 bits are zero


def _unpack(packed: bytes) -> np.ndarray:
    return unpack(packed + bytes(len(packed) // 5 * 3))


def shingle_sets(rows: DataFrame, width: int, narrow: int | None = None) -> DataFrame:
    """rows (rid, text) -> rid, n, sketch (BITS parities of shingles) and the shingles as 40-bit hashes, sorted, as byte planes of their differences (four bytes a shingle once
    compressed; two different shingles of a pair of texts of a thousand words are taken for one with a chance of 1e-6), and same, a digest
    of the set, and fp, the SimHash of the shingles of `narrow` words (null without). Texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(t, width) >> np.uint64(24)) for t in batch.column(1).to_pylist()]
            full = pa.array([len(s) > 0 for s in made], pa.bool_())
            packed = [_pack(s) for s in made if len(s)]
            same = [xxhash.xxh3_128_digest(s.tobytes()) for s in made if len(s)]
            sketch = [np.packbits(np.bincount((s % np.uint64(BITS)).view(np.int64), minlength=BITS) & 1).tobytes() for s in made if len(s)]
            n = pa.array([len(s) for s in made if len(s)], pa.int32())
            fp = pa.array([majority(shingle_hashes(t, narrow)) if narrow else None for t in batch.column(1).filter(full).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(full), n, pa.array(packed, pa.binary()), pa.array(same, pa.binary()), pa.array(sketch, pa.binary()), fp], ["rid", "n", "set", "same", "sketch", "fp"])

    return arrow_map(rows, run, "rid bigint, n int, set binary, same binary, sketch binary, fp bigint")


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) for rows (rid, fp): every row with the least of its fingerprint, and these wherever deletion variants link two fingerprints."""
    fps = settle(rows.groupBy("fp").agg(F.min("rid").alias("first")))
    equal = settle(rows.join(fps.hint("merge"), "fp").where("rid <> first").select(F.col("first").alias("a"), F.col("rid").alias("b")).distinct())
    x, y = (fps.select(F.col("fp").alias(of), F.col("first").alias(f"{of}_rid")) for of in ("a", "b"))
    near = fingerprint_links(fps).join(x, "a").join(y, "b").select(F.col("a_rid").alias("a"), F.col("b_rid").alias("b"))
    return equal.unionAll(settle(near))


def possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs (a, b, n, x, y), n shingles in both sets together, whose sketches allow the similarity: sketches differ in
    at most as many bits as the sets differ in shingles, so no similar pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in (3, 4))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array((1 + similarity) * apart <= (1 - similarity) * batch.column(2).to_numpy() + SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return arrow_map(pairs, run, "a bigint, b bigint")


def similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs (a, b, x, y) whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = _unpack(x), _unpack(y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(common >= similarity * (len(p) + len(q) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return arrow_map(pairs, run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", narrow: int | None = None) -> DataFrame:
    """rid, doc_id and keep_id of the texts that go: keep_id is the id of a text that stays and is linked to them, if by way of others.

    rid is xxhash64(doc_id, text): rows that repeat both id and text are one text. Of linked texts the smallest id stays.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    made = settle(shingle_sets(rows.select("rid", "text"), width, narrow).withColumn("row", F.monotonically_increasing_id()))
    first = made.groupBy("same").agg(F.min(F.struct("rid", "row")).alias("first"))
    again = settle(made.select("rid", "row", "same").join(first, "same").where("row <> first.row").select("rid", "row", "first"))
    links = again.where("rid <> first.rid").select(F.col("first.rid").alias("a"), F.col("rid").alias("b")).distinct()
    if narrow:
        links = links.unionAll(fingerprint_pairs(made.select("rid", "fp")))
    sets = settle(made.join(again.select("row"), "row", "left_anti").select("rid", "n", "set", "sketch"))

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("rid").alias(of), F.col("n").alias(f"{of}_n"), F.col("sketch").alias(f"{of}_s")) for of in ("a", "b"))
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"), "a_s", "b_s")
        pairs = settle(possible(pairs, similarity))
        touched = pairs.select(F.col("a").alias("rid")).unionAll(pairs.select("b")).distinct()
        some = settle(sets.select("rid", "set").join(touched, "rid", "left_semi"))
        both = pairs.join(some.select(F.col("rid").alias("a"), F.col("set").alias("x")), "a").join(some.select(F.col("rid").alias("b"), F.col("set").alias("y")), "b")
        return settle(similar(both.select("a", "b", "x", "y"), similarity))

    members = settle(shared_keys(prefixes(sets, similarity, common_shingles(sets))))
    tried = settle(hub_pairs(members, similarity))
    near = verified(tried)
    links = links.unionAll(near)
    rest = settle(other_pairs(members, components(links), similarity).join(tried, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        links = links.unionAll(verified(rest))
    ids = rows.select("rid", "id").dropDuplicates(["rid"])
    named = settle(components(links).join(ids, F.col("node") == F.col("rid")))
    keeps = settle(named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("keep")))  # written, as is named: a hot root can be split
    return named.join(keeps, "root").where("rid <> keep.rid").select("rid", F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"))


def near_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", narrow: int | None = None) -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    Texts (ASCII lower case, words between white space) link at a Jaccard similarity of `similarity` or more of their
    sets of `width`-word shingles, and with `narrow` also where the SimHashes of their `narrow`-word shingles, repeats
    included, differ in two bits or fewer (see simhash). Null texts and texts without words link with nothing and stay. A null id loses to
    any other. Rows that repeat id and text stay or go together. An empty table gives an empty result.
    """
    r, rid = (free_prefix(docs) + x for x in ("r", "rid"))
    gone = near_duplicates(docs, width, similarity, id_col, text_col, narrow).select(F.col("rid").alias(rid)).distinct()
    return docs.withColumn(r, F.xxhash64(F.col(id_col), F.col(text_col))).join(gone, F.col(r) == F.col(rid), "left_anti").select(*docs.columns)
