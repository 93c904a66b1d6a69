"""The training-data operators against brute force, and on awkward tables."""

import collections
import functools
import glob
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from plait.llm import byte_bpe, chat_format, mixing, near_dedup, quality, queries, sharding, simhash, substring_dedup, token_output, topk_search
from plait.llm.components import components
from plait.llm.exact_dedup import exact_dedup, groups_of_equal_texts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, keep_id string, n_tokens string"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = prose(9000)
SHARED = prose(60)


@functools.cache
def awkward():
    texts = [None, "", " \n\t", "one", "two words", "A B c", "a b C", LONG, LONG, "x" * 3000, "é" * 900 + " ß", "same text here", "same text here", "same text here", prose(50) + " " + SHARED, SHARED + " " + prose(30), SHARED]
    texts += [prose(RNG.randint(1, 120)) for _ in range(20)]
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return [*out, out[12], (None, "no id", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: [(x is None, x) for x in t])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Exact dedup.


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, keep):
    groups = collections.defaultdict(list)
    for r in awkward():
        groups[r[1] or ""].append(r[0])
    found = by_id(groups_of_equal_texts(docs, keep=keep), "doc_id", "text", "keep_id", "group_size", "kept", "text_sha256")
    assert len(found) == len(awkward())
    for i, t, k, n, _, digest in found:
        ids = [x for x in groups[t or ""] if x is not None]
        assert k == ((max if keep == "largest" else min)(ids) if ids else None) and n == len(groups[t or ""]) and digest == sha(t or "")
    kept = [t or "" for _, t, _, _, k, _ in found if k]
    assert sorted(kept) == sorted(groups)
    assert exact_dedup(docs).columns == docs.columns and exact_dedup(docs).count() == len(groups)
    clash = docs.withColumns({"__hash": F.lit("x"), "__text": F.lit("y"), "__salt": F.lit("z")})
    for r in groups_of_equal_texts(clash, keep=keep).collect():
        assert (r["__hash"], r["__text"], r["__salt"]) == ("x", "y", "z")
    assert {r["keep_id"] for r in exact_dedup(docs).collect() if r["doc_id"] is not None} == {"y"}


def test_exact_dedup_of_a_hot_group_and_of_nothing(spark, empty):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    found = groups_of_equal_texts(rows, keep="largest").where("text = 'hot'")
    assert {(r["keep_id"], r["group_size"]) for r in found.collect()} == {(2997, 1000)} and found.where("kept").count() == 1
    assert groups_of_equal_texts(empty).count() == 0
    with pytest.raises(ValueError):
        groups_of_equal_texts(rows, keep="first")
    lower = groups_of_equal_texts(spark.createDataFrame([(1, "A"), (2, "a")], "doc_id int, text string"), normalise=F.lower("text"))
    assert {r["group_size"] for r in lower.collect()} == {2}


# Byte-level BPE.


def test_bpe_equals_the_library(docs, empty):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})
    made = byte_bpe.encode(docs, PATH, PATTERN)
    assert [c for c in made.columns if c not in ("token_ids", "decoded")] == [c for c in docs.columns if c != "n_tokens"] + ["n_tokens"]
    for r in made.collect():
        assert r["token_ids"] == enc.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(r["token_ids"])
    again = byte_bpe.decode(made.select("text", "token_ids"), PATH)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in again.collect())
    texts = collections.Counter((r[0], r[1] or "") for r in awkward())
    want = collections.Counter()
    for (i, t), n in texts.items():
        ids = enc.encode_ordinary(t)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(t)] += n
    got = byte_bpe.digests(docs, PATH, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and collections.Counter(map(tuple, got.collect())) == want
    clash = made.select("token_ids", F.lit(1).alias("Decoded"))
    assert byte_bpe.decode(clash, PATH).columns == ["token_ids", "decoded"]
    assert byte_bpe.encode(empty, PATH, PATTERN).count() == 0


def test_bpe_of_hard_words():
    codec = byte_bpe.Codec(PATH)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choice(["a", "b", "ab", "the", "é", "漢", "ing", " "]) for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["a" * 5000, "ab" * 300]
    known = codec.learn([words])
    for w in words:
        ids = [int(i) for i in known[w][0].split()]
        assert ids == enc._encode_single_piece(w.encode()) and known[w][2] == w.encode() and known[w][1] == len(ids)


# Quality.


def test_bpe_words_in_use_stay_known(monkeypatch):
    """A full cache forgets words that have not come up for long, and none that every batch has."""
    codec, asked = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken")), []
    query = codec._by_query
    monkeypatch.setattr(codec, "_by_query", lambda raw: asked.extend(raw) or query(raw))
    monkeypatch.setattr(byte_bpe, "CACHE", 60)
    codec.cache = 60
    often = [f" zqoften{i}xv" for i in range(10)]
    for k in range(12):
        rare = [f" zqrare{k // 2}x{i}xv" for i in range(25)]
        ids = codec.meet(often + rare)
        assert [codec.decode([list(map(int, x.split()))])[0].decode() for x in ids] == often + rare
        assert len(codec.known) + len(codec.before) <= 60 + 35
    assert max(collections.Counter(asked)[w.encode()] for w in often) == 2  # learnt, and kept from the second time on


def test_quality_learns_grades(spark, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(WORDS) for _ in range(40)]
        grade = i % 3
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        elif grade == 1:
            words[5] = words[20] = "badword"
        rows.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, int(grade > 0), int(grade == 1)))
    labels += [(5, None, 0), (None, 1, 0), (10**6, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, frame, quality.grade_of_labels())
    assert (np.diff(model.thresholds) > 0).all()
    held = [r for r in quality.score(docs, model).collect() if r["doc_id"] >= 600]
    assert np.mean([r["keep"] == (r["doc_id"] % 3 == 2) for r in held]) > 0.97
    means = [np.mean([r["expected_grade"] for r in held if r["doc_id"] % 3 == g]) for g in range(3)]
    assert means == sorted(means)
    none = quality.train(docs, frame.limit(0), quality.grade_of_labels())
    assert quality.score(docs, none).where("keep").count() == len(rows)
    odd = spark.createDataFrame(awkward(), SCHEMA).withColumn("keep", F.lit("clash"))
    assert quality.score(odd, model).count() == len(awkward())
    assert quality.score(empty, quality.train(empty, frame, quality.grade_of_labels())).count() == 0


def plain_loss(w, d, cuts, rows, rates, grades):
    """Mean negative log-likelihood of an ordinal model, one row at a time."""
    total = 0.0
    for words, rate, g in zip(rows, rates, grades, strict=True):
        x = sum(w[b] for b in words) + sum(a * b for a, b in zip(d, rate, strict=True))
        upto = [0.0, *(1 / (1 + np.exp(x - c)) for c in cuts), 1.0]
        total -= np.log(upto[g + 1] - upto[g])
    return total / len(rows)


def test_quality_fit_is_the_penalised_maximum():
    rng = np.random.default_rng(5)
    truth = {b: t for b, t in zip(range(100, 112), rng.normal(size=12) * 1.5, strict=True)}
    rows = [sorted(rng.choice(list(truth), 5, replace=False).tolist()) for _ in range(240)]
    rates = rng.random((240, quality.RATES)) * 0.2
    latent = np.array([sum(truth[b] for b in r) for r in rows]) + rng.logistic(size=240)
    grades = np.digitize(latent, [-1.0, 1.0])
    lasso, lengths = 2e-3, np.full(240, 5)
    model = quality.fit(np.concatenate(rows).astype(np.int32), lengths, rates, grades, 3, rounds=4000, rate=0.01, lasso=lasso)
    w = {b: model.weights[b] for b in truth}
    assert np.count_nonzero(model.weights) == sum(x != 0 for x in w.values())
    base = plain_loss(w, model.rates, model.thresholds, rows, rates, grades)
    step = 1e-4
    for b in truth:  # at the maximum the slope is that of the penalty, or within it where a weight is 0
        up, down = ({**w, b: w[b] + s} for s in (step, -step))
        slope = (plain_loss(up, model.rates, model.thresholds, rows, rates, grades) - plain_loss(down, model.rates, model.thresholds, rows, rates, grades)) / (2 * step)
        assert abs(slope + lasso * np.sign(w[b])) < 1e-3 if w[b] else abs(slope) < lasso + 1e-3
    for j in range(2):
        moved = model.thresholds.copy()
        moved[j] += 0.05
        assert plain_loss(w, model.rates, moved, rows, rates, grades) > base
        moved[j] -= 0.1
        assert plain_loss(w, model.rates, moved, rows, rates, grades) > base


def plain_score(text, model):
    words = (text or "").split()
    buckets, n = set(), len(words)
    for word in words:
        core = "".join(re.findall(r"\w+", word.lower()))
        buckets |= {xxhash.xxh32_intdigest(x.encode(), k) % quality.BUCKETS for k, x in enumerate((core, core[:4], core[:5]))}
    cores = ["".join(re.findall(r"\w+", w.lower())) for w in words]
    if not n:
        return 0.0
    keys = [(c, len(c) > 1 and w.isupper(), bool(re.search(r"[^\w\s]{2}", w))) for c, w in zip(cores, words, strict=True)]
    rates = [np.mean([k[1] for k in keys]), np.mean([k[2] for k in keys]), np.mean([not c for c in cores]), np.mean([a == b for a, b in zip(cores, cores[1:], strict=False)]) if n > 1 else 0.0, max(0.0, 0.5 - len(set(keys)) / n) if n > 30 else 0.0, float(n < 5)]
    return sum(model.weights[b] for b in buckets) + float(np.dot(rates, model.rates))


def test_quality_scores_are_those_of_the_model(spark):
    rng = np.random.default_rng(8)
    model = quality.OrdinalModel(rng.normal(size=quality.BUCKETS) * 0.1, rng.normal(size=quality.RATES), np.array([-0.4, 0.3]))
    rows = awkward()
    found = quality.score(spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "k int, text string"), model).collect()
    assert len(found) == len(rows)
    for r in found:
        x = plain_score(rows[r["k"]][1], model)
        tails = [1 / (1 + np.exp(c - x)) for c in model.thresholds]
        assert abs(r["score"] - x) < 1e-9 and abs(r["expected_grade"] - sum(tails)) < 1e-9 and abs(r["p_tail"] - tails[1]) < 1e-9 and r["keep"] == (tails[1] >= 0.6)


def test_quality_bounds_its_sample(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7 + 1))) for i in range(40)] * 2
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda cols, lengths, rates, grades, n: seen.append((len(cols), len(grades))))
    for limit, most in ((100, 10**6), (10, 10**6), (100, 30)):
        quality.train(docs, labels, quality.grade_of_labels(), limit=limit, most=most)
    assert seen[0][1] == 40 and seen[1][1] == 10 and seen[2][0] <= 30 and 0 < seen[2][1] < 40


# Top-k.


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32)]) for i in range(300)]
    data += [(300 + i, data[7][1]) for i in range(40)]  # ties
    data += [(400, None), (401, [1.0, None] * 6), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (None, data[1][1]), (404, [1.0, 2.0]), (405, [0.5, 0.5]), (410, []), (411, [])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id bigint, embedding array<float>, score string")
    found = collections.defaultdict(list)
    for r in topk_search.exact_top_k(vectors, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(64 * np.array(v, np.float32).astype(np.float64)) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in good if i % 10 == 0]:
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:5]
        assert found.pop(q, []) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not found
    assert topk_search.exact_top_k(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        topk_search.exact_top_k(spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_top_k_skips_blocks_out_of_reach(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(size=8) * (0.02 if i >= 60 else 1)]) for i in range(3000)]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").coalesce(1)
    found = collections.defaultdict(list)
    for r in topk_search.exact_top_k(vectors, F.col("vec_id") < 20, k=5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    good = {i: np.floor(64 * np.array(v)) for i, v in data}
    for q in range(20):
        assert found[q] == [(i, -s) for s, i in sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]]


def test_top_k_with_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(100)], "vec_id bigint, embedding array<double>")
    assert topk_search.exact_top_k(vectors, F.col("vec_id") % 4 == 0, k=3).count() == 75


# SimHash.


def fingerprint(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(docs, empty):
    rows = awkward()
    fps = [fingerprint(r[1], 3) for r in rows]
    roots = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min([x for x in (least.get(root), r[0]) if x is not None], default=None)
    want = sorted(((r[0], f"{f:016x}", least[root]) for r, f, root in zip(rows, fps, roots, strict=True)), key=str)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == want
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("hot", [64, 3])
def test_links_are_all_pairs_within_two_bits(spark, hot):
    rng = random.Random(hot)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = simhash.links(frame, hot)
    at = {x: i for i, x in enumerate(signed)}
    pairs = [(at[r["a"]], at[r["b"]]) for r in got.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in pairs)
    want = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert union(len(fps), pairs) == union(len(fps), want)
    if hot == 64:
        assert {frozenset(p) for p in pairs} == {frozenset(p) for p in want} and len(pairs) == len(want)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(70)] + [(100, 101), (101, 102), (200, 200)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert found == {**dict.fromkeys(range(71), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_near_dedup(spark, docs, empty):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        words = [rng.choice(WORDS) for _ in range(200)]
        rows.append((i * 10, " ".join(words)))
        want[i * 10] = i * 10
        if i % 3 == 0:  # near copies: two changed words spoil ten of 196 shingles
            for k in (1, 2):
                copy = list(words)
                copy[20 * k] = copy[90 + k] = "changed"
                rows.append((i * 10 + k, " ".join(copy)))
        if i % 3 == 1:  # similar, but not enough
            copy = [rng.choice(WORDS) if j % 9 == 0 else w for j, w in enumerate(words)]
            rows.append((i * 10 + 5, " ".join(copy)))
            want[i * 10 + 5] = i * 10 + 5
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup(frame).collect()) == sorted(want)
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    texts = collections.Counter(r["text"] for r in kept.collect())
    assert texts[None] == 1 and texts[""] == 1 and texts[LONG] == 1 and texts["same text here"] == 1
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 16)
    rng = random.Random(4)
    words = [rng.choice(WORDS) for _ in range(300)]
    rows = [(0, " ".join(words))]
    for i in range(1, 90):
        copy = list(words)
        copy[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r["doc_id"] for r in near_dedup.near_dedup(frame).collect()] == [0]


def near_kept(rows, similarity=0.8, width=5):
    """Brute force: ids that stay of (id, text), by links of all pairs."""
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if (w := t.split()) else set() for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) > 0 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def star(rng, first, copies, words=300, changed=9):
    """A base and copies that are similar to it and not to each other; the base has the largest id."""
    base = [rng.choice(WORDS) for _ in range(words)]
    out = [(first + copies, " ".join(base))]
    for i in range(copies):
        copy = list(base)
        for k in rng.sample(range(0, words // 10), changed - 3):
            copy[10 * k + 5] = f"new{first}x{i}x{k}"
        out.append((first + i, " ".join(copy)))
    return out


def test_near_dedup_of_star_groups(spark):
    rng = random.Random(11)
    rows = [r for g in range(4) for r in star(rng, 1000 * g, 30)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert all(alike(sets[0], s) >= 0.8 for s in sets[1:31]) and sum(alike(sets[1], s) >= 0.8 for s in sets[2:31]) < 15
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup(frame).collect()) == near_kept(rows) == [0, 1000, 2000, 3000]


def test_near_dedup_of_same_words(spark):
    """Texts of the same words in another order are all candidates of each other; two or three of them are similar."""
    rng = random.Random(12)
    words, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        rng.shuffle(words)
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 1 + i % 3):
            at = 30 * k
            rows.append((10 * i + k, " ".join([*words[:at], words[at + 1], words[at], *words[at + 2 :]])))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup(frame).collect()) == near_kept(rows)


def test_near_dedup_of_blocks(spark):
    """Blocks of new words at the head, the end or inside, and cut texts, up to the similarity."""
    rng = random.Random(13)
    rows, fresh = [], lambda i, n: [f"b{i}x{k}" for k in range(n)]
    for i in range(120):
        words = [rng.choice(WORDS) for _ in range(rng.randint(60, 300))]
        n = len(words)
        rows.append((10 * i, " ".join(words)))
        for k, part in enumerate((0.1, 0.17, 0.22, 0.24, 0.3), 1):
            more, at = fresh(f"{i}y{k}", int(part * n)), rng.randrange(n)
            made = [words + more, more + words, words[:at] + more + words[at:], words[: int(n * (1 - 0.8 * part))]][(i + k) % 4]
            rows.append((10 * i + k, " ".join(made)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup(frame).collect()) == near_kept(rows)


def test_near_dedup_at_other_similarities(spark):
    rng = random.Random(14)
    rows = []
    for i in range(40):
        words = [rng.choice(WORDS) for _ in range(100)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words, *(f"b{i}x{k}" for k in range(20 + 2 * i))]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for similarity in (0.6, 0.75, 1.0):
        assert sorted(r["doc_id"] for r in near_dedup.near_dedup(frame, similarity=similarity).collect()) == near_kept(rows, similarity)
    with pytest.raises(ValueError):
        near_dedup.near_dedup(frame, similarity=0.0)


def test_common_shingles_are_counted_in_all_texts(spark, empty, monkeypatch):
    """Runs of a key that is taken for rare grow with the table, and their pairs with the square: no key that many texts have is missed."""
    text = F.expr("concat_ws(' ', if(id < 6, 'a b c d e', null), concat('p', id % 5000), 'q', 'r', 's', concat('t', id % 5000))")
    sets = near_dedup.shingle_sets(spark.range(20_000).select(F.col("id").alias("rid"), text.alias("text")), 5)
    keys, counts = near_dedup.common_shingles(sets)
    words = ["a", "b", "c", "d", "e"]
    hashed = lambda w: int(near_dedup.shingle_hashes(" ".join(w), 5)[0] >> np.uint64(24))
    want = {hashed(words): 6} | {hashed([f"p{i}", "q", "r", "s", f"t{i}"]): 4 for i in range(5000)}
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and keys.tolist() == sorted(want)
    monkeypatch.setattr(near_dedup, "COMMON", 4999)  # those of four texts do not all go in
    monkeypatch.setattr(near_dedup, "RANGE", 1000)
    assert [x.tolist() for x in near_dedup.common_shingles(sets)] == [[hashed(words)], [6]]
    assert [len(x) for x in near_dedup.common_shingles(near_dedup.shingle_sets(empty.select(F.col("doc_id").alias("rid"), "text"), 5))] == [0, 0]


# Substring dedup.


def removed(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("width", [1, 5, 35])
def test_substring_dedup(docs, empty, width):
    rows = awkward()
    want = sorted(zip([r[0] for r in rows], removed([r[1] for r in rows], width), strict=True), key=str)
    found = substring_dedup.substring_dedup(docs, width).collect()
    got = sorted(((r["doc_id"], (r["n_words"], r["n_removed"], r["kept"])) for r in found), key=str)
    assert got == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False)) for r in found)
    assert substring_dedup.substring_dedup(empty, width).count() == 0


def test_packing():
    h = np.unique(np.random.default_rng(0).integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert (substring_dedup.unpack(substring_dedup.pack(h)) == h).all()
    assert len(substring_dedup.unpack(substring_dedup.pack(h[:0]))) == 0


# Sharding.


def test_sharding(docs, empty):
    rows = awkward()
    found = sharding.shard_documents(docs, shards=4).collect()
    assert len(found) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    place = collections.defaultdict(set)
    for r in found:
        place[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(v) == 1 for v in place.values()) and {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}
    assert sharding.shard_documents(empty).count() == 0


def test_differencing_balances(spark):
    rng = random.Random(6)
    sizes = [rng.randint(1, 5000) for _ in range(500)]
    shard = sharding.differencing(sizes, 16)
    sums = [sum(s for s, k in zip(sizes, shard, strict=True) if k == b) for b in range(16)]
    assert max(sums) - min(sums) <= 8
    assert sharding.differencing([], 4) == [] and sorted(sharding.differencing([5, 4, 3], 3)) == [0, 1, 2]
    halves = sharding.differencing([8, 7, 6, 5, 4], 2)  # differencing gives 16 and 14, the known result for these
    assert sorted(sum(x for x, k in zip([8, 7, 6, 5, 4], halves, strict=True) if k == b) for b in (0, 1)) == [14, 16]
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("t"), F.col("id") % 3900, F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))).alias("text"))
    totals = [r["t"] for r in sharding.shard_documents(many).groupBy("shard").agg(F.sum("size").alias("t")).collect()]
    assert len(totals) == 16 and max(totals) - min(totals) <= 4


def plain_differencing(sizes, shards):
    """Sums of the shards: the two partial partitions of the largest spread combined in opposite order, until one is left."""
    parts = [(sorted([s] + [0] * (shards - 1), reverse=True), i) for i, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[0][-1] - p[0][0], p[1]))
        (a, _), (b, _) = parts.pop(0), parts.pop(0)
        parts.append((sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True), made))
        made += 1
    return parts[0][0]


@pytest.mark.parametrize("chunk", [4096, 16])
def test_differencing_equals_a_plain_one(monkeypatch, chunk):
    monkeypatch.setattr(sharding, "CHUNK", chunk)
    rng = random.Random(chunk)
    for n, shards in ((1, 4), (7, 3), (100, 16), (300, 5)):
        sizes = [rng.choice([1, 2, 50, rng.randint(1, 10**6)]) for _ in range(n)]
        sums, shard = sharding.place_groups(np.array(sizes), [0] * shards)
        assert sums == [sum(s for s, k in zip(sizes, shard, strict=True) if k == b) for b in range(shards)]
        if n <= chunk:
            assert sorted(sums, reverse=True) == plain_differencing([0, *sizes], shards)
    given = [5000, 0, 300, 20]
    sums, shard = sharding.place_groups(np.array([rng.randint(1, 99) for _ in range(900)]), given)
    assert max(sums) - min(sums) <= 4 and sums[0] > 5000  # what was there before is made up for


def test_sharding_of_hot_texts(spark):
    """Texts over an even share, and just under it: the others make up for them."""
    rng = random.Random(3)
    texts = ["h" * 60_000, "i" * 5000, *("j" * 900 for _ in range(5)), *(rng.choice("abc") * rng.randint(1, 60) + str(i) for i in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sums = sorted(r["t"] for r in sharding.shard_documents(docs, shards=8).groupBy("shard").agg(F.sum("size").alias("t")).collect())
    assert sums[-1] == 60_001 and sums[-2] - sums[0] <= 40


# Mixing.


def test_exponents():
    tokens = [900, 50, 30, 20]
    a, _ = mixing.exponent_for(tokens, 0.9, None, None)
    assert abs(mixing.entropy(mixing.weights(tokens, a)) - 0.9 * np.log(4)) < 1e-9 and 0 < a < 1
    b, budget = mixing.exponent_for(tokens, None, 3.0, None)
    w = mixing.weights(tokens, b)
    assert abs(max(budget * x / t for x, t in zip(w, tokens, strict=True)) - 3) < 0.01 and min(budget * x / t for x, t in zip(w, tokens, strict=True)) >= 1
    assert mixing.exponent_for([], None, None, None) == (1.0, 0) and mixing.exponent_for(tokens, None, None, 10)[0] == 1.0


def test_mixture_keeps_its_budget(spark, docs, empty):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"))
    words = F.regexp_count("text", F.lit(r"\w+"))
    plan = mixing.mix_plan(rows, repetition=2.0, tokens=words)
    for r in plan.groupBy("source").agg(F.first("token_budget").alias("b"), F.sum(F.col("n_tokens") * F.col("copies")).alias("got"), F.min("copies").alias("low"), F.max("copies").alias("high")).collect():
        assert 0 <= r["b"] - r["got"] < 10 and r["low"] >= 1 and r["high"] <= 2
    assert mixing.mix(rows, repetition=2.0, tokens=words).count() == plan.agg(F.sum("copies")).first()[0]
    small = mixing.mix_plan(rows, budget=3000, tokens=words)
    assert 2960 <= small.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] <= 3000
    mixed = mixing.mix(docs, repetition=2.0)
    assert mixed.columns == docs.columns and mixed.select("text").distinct().count() == docs.select("text").distinct().count()
    assert mixing.mix(empty, repetition=2.0).count() == 0 and mixing.mix_plan(empty, target_entropy=0.9).count() == 0


def plain_copies(spark, rows, source, n_tokens, seed=11, **targets):
    """doc_id -> copies for rows (doc_id, text): whole passes, and one more for the documents at the head of the permutation as far as the budget goes."""
    place = {r["id"]: r["p"] for r in spark.createDataFrame([(i,) for i, _ in rows], "id bigint").select("id", mixing.permuted("id", seed).alias("p")).collect()}
    by = collections.defaultdict(list)
    for i, t in rows:
        by[source(i)].append((place[i], i, n_tokens(t)))
    names = sorted(by, key=str)
    tokens = [sum(n for *_, n in by[s]) for s in names]
    exponent, budget = mixing.exponent_for(tokens, targets.get("target_entropy"), targets.get("repetition"), targets.get("budget"))
    out = {}
    for s, t, w in zip(names, tokens, mixing.weights(tokens, exponent), strict=True):
        passes, rest = divmod(int(budget * w * (1 + 1e-12)), t) if t else (1, 0)
        for _, i, n in sorted(by[s]):
            rest = rest - n if 0 <= rest and n <= rest else -1
            out[i] = passes + (rest >= 0 and t > 0)
    return out


@pytest.mark.parametrize("few", [100_000, 2])
@pytest.mark.parametrize("targets", [{"repetition": 2.0}, {"target_entropy": 0.97, "repetition": 4.0}, {"target_entropy": 0.8}, {"budget": 30_000}])
def test_mixture_equals_a_plain_one(spark, monkeypatch, few, targets):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 8)
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))) for i in range(900)]
    source = lambda i: None if i % 11 == 0 else "big" if i % 4 else f"s{i % 3}"
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})
    frame = spark.createDataFrame([(i, t, source(i)) for i, t in rows], "doc_id bigint, text string, source string")
    found = mixing.mix_plan(frame, **targets).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: len(enc.encode_ordinary(t)) for i, t in rows}
    want = plain_copies(spark, rows, source, lambda t: len(enc.encode_ordinary(t)), **targets)
    assert {r["doc_id"]: r["copies"] for r in found} == want
    if "budget" in targets:
        clash = frame.withColumns({"__copies": F.lit("x"), "__cut": F.lit("y")})
        mixed = mixing.mix(clash, **targets)
        assert mixed.columns == clash.columns and {r["__copies"] for r in mixed.collect()} == {"x"}
        assert collections.Counter(r["doc_id"] for r in mixed.collect()) == {i: n for i, n in want.items() if n}


# Token output.


def test_permutations():
    for n in (1, 2, 3, 5, 16, 17, 1000):
        p = token_output.Permutation(n, 3)
        slots = p.slot(np.arange(n))
        assert sorted(slots) == list(range(n)) and (p.number(slots) == np.arange(n)).all()
    assert (token_output.Permutation(1000, 3).slot(np.arange(1000)) != token_output.Permutation(1000, 4).slot(np.arange(1000))).any()


def plain_slot(x, n, key):
    """The slot of sequence x of n, by a Feistel network with cycle-walking in plain integers."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    keys = [(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64 for r in range(6)]
    while True:
        left, right = x >> half, x % (1 << half)
        for k in keys:
            h = right
            for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                h = (h ^ k) * factor % 2**64
                h ^= h >> 29
            left, right = right, left ^ ((h ^ h >> 32) % (1 << half))
        x = left << half | right
        if x < n:
            return x


def written(folder):
    """The bytes of each shard in a folder."""
    files = [re.search(r"from-(\d+)/part-(\d+)", f) for f in glob.glob(f"{folder}/from-*/part-*")]
    return {int(m[1]) + int(m[2]): open(m.string, "rb").read() for m in files}


@pytest.mark.parametrize("rounds", [1, 3, 100])
def test_shards_round_trip(docs, empty, tmp_path, rounds):
    order = token_output.training_order(docs, PATH, PATTERN, length=32, shard_slots=20)
    token_output.write_shards(order, str(tmp_path / "s"), rounds)
    shards = written(tmp_path / "s")
    rows = order.places().collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    numbers = {plain_slot(x, len(rows), 1): x for x in range(len(rows))}
    last = {}
    for r in sorted(rows, key=lambda r: numbers[r["slot"]]):  # sequences of a document follow each other in the numbering
        assert r["seq"] in (0, last.get(r["doc_id"], -1) + 1)
        last[r["doc_id"]] = r["seq"]
    parts = collections.defaultdict(dict)
    for r in rows:
        assert r["slot"] == r["shard"] * 20 + r["offset"] // 66
        ids = token_output.read_slots(shards[r["shard"]], 32, r["slot"] % 20, 1)[0]
        assert (ids[r["n_tokens"] :] == token_output.PAD).all()
        parts[r["doc_id"]].setdefault(r["seq"], []).append(ids[: r["n_tokens"]])
    assert sum(map(len, shards.values())) == 66 * len(rows)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})
    for r in awkward():
        if r[0] is not None:
            ids = np.concatenate([parts[r[0]][k][0] for k in sorted(parts[r[0]])]).tolist()
            assert ids == [*enc.encode_ordinary(r[1] or ""), 50256]
    with pytest.raises(ValueError):
        token_output.read_slots(shards[0], 31, 0, 1)
    nothing = token_output.training_order(empty, PATH, PATTERN)
    token_output.write_shards(nothing, str(tmp_path / "none"), rounds)
    assert nothing.places().count() == 0 and not any(written(tmp_path / "none").values())


# Chat formatting.


def test_tool_calls(spark):
    call = lambda i, name, args: (i, name, args)
    rows = [
        (1, 0, "user", "hi", None, None),
        (1, 1, "assistant", None, [call("a", "add", '{"y": 2, "x":1}'), call("b", "add", '{"x":"1"}')], None),
        (1, 5, "tool", "3", None, "a"),
        (1, 2, "assistant", "then", [call("c", "nope", "not json")], None),
        (1, 3, "tool", "chain", [call("d", "add", '{"x": 1, "y": null}')], "c"),
        (1, 4, "tool", "end", None, "d"),
        (1, 6, "tool", "lost", None, "zzz"),
        (2, 0, "tool", "self", [call("s", "add", "[]")], "s"),
        (None, None, None, None, None, None),
        (1, 0, "user", "hi", None, None),
    ]
    schema = f"conv_id bigint, turn bigint, role string, text string, calls {chat_format.CALLS}, result_of string, depth string"
    frame = spark.createDataFrame([(*r, "x") for r in rows], schema)
    rules = {"add": {"x": {"type": "integer", "required": True}, "y": {"type": "integer", "required": True}}}
    found = chat_format.link_tool_calls(frame, rules)
    at = {(r["conv_id"], r["turn"]): r for r in found.collect()}
    assert found.count() == len(rows)
    assert at[1, 5]["call_turn"] == 1 and (at[1, 5]["order_turn"], at[1, 5]["depth"]) == (1, 1)
    assert (at[1, 3]["order_turn"], at[1, 3]["depth"]) == (2, 1) and (at[1, 4]["order_turn"], at[1, 4]["depth"]) == (2, 2)
    assert at[1, 6]["call_turn"] is None and at[2, 0]["call_turn"] is None
    assert at[1, 1]["errors"] == "x: not of type integer, y: missing" and at[1, 1]["n_answered"] == 1 and at[1, 1]["n_calls"] == 2
    assert at[1, 2]["errors"] == "arguments: not an object, name: unknown tool" and at[1, 3]["errors"] == "y: missing"
    message = json.loads(at[1, 1]["message"])
    assert message["tool_calls"][0]["arguments"] == {"x": 1, "y": 2} and '"arguments":{"x":1,"y":2}' in at[1, 1]["message"]
    assert json.loads(at[1, 2]["message"])["tool_calls"][0]["arguments"] == "not json"
    assert json.loads(at[1, 5]["message"])["tool_call_id"] == "a" and json.loads(at[None, None]["message"]) == {"content": None, "role": None}
    order = [(r["order_turn"], r["depth"], r["turn"]) for r in found.where("conv_id = 1").orderBy("order_turn", "depth", "turn").collect()]
    assert [t for _, _, t in order] == [0, 0, 1, 5, 2, 3, 4, 6]
    assert chat_format.link_tool_calls(frame.limit(0), rules).count() == 0


def test_conversations_without_calls(spark):
    frame = spark.createDataFrame([(1, 0, "user", 'say "x"\n'), (1, 1, "assistant", "x"), (1, 2, "user", "y" * 401), (2, 0, "assistant", "z"), (3, None, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    found = {(r["conv_id"], r["turn"]): r for r in chat_format.link_tool_calls(chat_format.turns_as_calls(frame), chat_format.REPLY).collect()}
    assert found[1, 1]["call_turn"] == 0 and found[1, 0]["n_answered"] == 1 and found[1, 2]["errors"] == "prompt: too long" and found[2, 0]["call_turn"] is None
    assert json.loads(found[1, 0]["message"])["tool_calls"][0]["arguments"] == {"prompt": 'say "x"\n', "turn": 0}
    assert "prompt: missing" in found[3, None]["errors"]


def test_op4_writes_its_shards(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "shared_folder", lambda _: str(tmp_path / "shared"))
    rows = queries.op4_token_output(spark, str(tmp_path)).collect()
    (folder,) = glob.glob(str(tmp_path / "shared/shards-*"))
    shards = written(folder)
    assert len(rows) == sum(map(len, shards.values())) // 1026 and sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(r["record_sha256"] == hashlib.sha256(shards[r["shard"]][r["offset"] : r["offset"] + 1024]).hexdigest() for r in rows)
