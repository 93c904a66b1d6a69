"""The graph core on a small graph with a bubble, a reversal and an unvisited node."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from plait.functions import dna
from plait.functions.alignment import align, path_lcs, to_cigar
from plait.operators import components as C
from plait.operators import cover, kmers, lineage, paths, search, segments, windows
from plait.operators import graph as g
from plait.operators import paths as P
from plait.operators import stars
from plait.operators import subgraph as U
from plait.operators.graph import HapGraph
from plait.sources import gfa, gfa_out, store
from plait.streaming import incremental

LABELS = {1: "G", 2: "A", 3: "T", 4: "GGG", 5: "T", 6: "A", 7: "C", 8: "A", 9: "A"}
SHORT, ALT = [1, 4, 5, 6, 7, 9], [1, 2, 4, 5, 6, 8, 9]


def build(spark, labels, walks, senses=None):
    """walks: lists of signed node ids."""
    nodes = spark.createDataFrame([(n, s, len(s)) for n, s in labels.items()], "node_id bigint, seq string, len bigint")
    rows = [(p, i, abs(n), n < 0) for p, w in enumerate(walks) for i, n in enumerate(w)]
    steps = spark.createDataFrame(rows, "path_id bigint, step bigint, node_id bigint, is_rev boolean")
    meta = [(p, f"s{p}", "c", 1, 0, (senses or {}).get(p, "HAPLOTYPE")) for p in range(len(walks))]
    return g.HapGraph(nodes, spark.createDataFrame(meta, "path_id bigint, sample string, contig string, haplotype bigint, fragment bigint, sense string"), steps)


@pytest.fixture(scope="module")
def base(spark):
    return build(spark, LABELS, [SHORT, ALT, SHORT], {0: "REFERENCE"})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_are_the_consecutive_pairs(base):
    pairs = [(1, 2), (1, 4), (2, 4), (4, 5), (5, 6), (6, 7), (6, 8), (7, 9), (8, 9)]
    assert rows(base.edges) == [(a, False, b, False) for a, b in pairs]
    assert rows(base.visited.select("node_id")) == [(n,) for n in (1, 2, 4, 5, 6, 7, 8, 9)]


def test_reversed_edges_are_canonical_once(spark):
    gr = build(spark, {1: "A", 2: "C"}, [[1, -2], [2, -1], [1, -1], [-1, 1]])
    assert rows(gr.edges) == [(1, False, 1, True), (1, False, 2, True), (1, True, 1, False)]
    assert gr.edges_bi.count() == 4


def test_degrees_and_neighbours(base):
    found = {(n, r): (right, left) for n, r, right, left in rows(g.degrees(base).select("node_id", "is_rev", "right_degree", "left_degree"))}
    assert found[6, False] == (2, 1) and found[6, True] == (1, 2) and found[1, False] == (2, 0)
    left = g.follow_edges(base.nodes.where("node_id = 9").select("node_id", F.lit(False).alias("is_rev")), base.edges_bi, left=True)
    assert rows(left.select("next_id", "next_rev")) == [(7, False), (8, False)]


def test_followed_edges_are_not_sorted(spark, base):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = g.follow_edges(g.handles(base.nodes).select("node_id", "is_rev"), base.edges_bi, left=True)
        assert rows(left) == sorted((b, br, a, ar) for a, ar, b, br in rows(base.edges_bi))
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sequences_and_offsets(base):
    assert dict(rows(paths.sequences(base))) == {0: "GGGGTACA", 1: "GAGGGTAAA", 2: "GGGGTACA"}
    assert dict(rows(paths.sequences(base, reverse=True)))[0] == "TGTACCCC"
    assert [r[3] for r in sorted(paths.offsets(base).where("path_id = 0").select("path_id", "step", "node_id", "bp_offset").collect())] == [0, 1, 4, 5, 6, 7]


def test_find_and_extend(base):
    state = search.find(base.steps_bi, [(5, False), (6, False)])
    assert state.count() == 3
    assert rows(search.follow_paths(state, base.steps_bi)) == [(7, False, 2), (8, False, 1)]
    assert rows(search.follow_paths(state, base.steps_bi, backward=True, length=2)) == [(4, False, 3)]
    assert search.find(base.steps_bi, [(6, True), (5, True)]).count() == 3
    assert search.find(base.steps_bi, []).count() == 0


def brute_windows(labels, walks, w):
    both = [[(abs(n), n < 0) for n in walk] for walk in walks]
    both += [[(n, not r) for n, r in reversed(walk)] for walk in both]
    out, every = set(), set()
    for walk in both:
        for s in range(len(walk)):
            for e in range(s + 1, len(walk)):
                every.add(tuple(walk[s:e]))  # something goes on after it
    for walk in both:
        for s in range(len(walk)):
            target, bp = len(labels[walk[s][0]]) + w - 1, 0
            for e in range(s, len(walk)):
                bp += len(labels[walk[e][0]])
                if bp >= target:
                    break
            mine = tuple(walk[s : e + 1])
            if bp >= target or (bp >= w and mine not in every):
                out.add(mine)
    return {"".join("<" * r + ">" * (not r) + str(n) for n, r in x) for x in out}


def test_windows_match_brute_force(spark, base):
    found = {r[0] for r in windows.haplotype_windows(base, 3).select(windows.walk_text(F.col("nodes"))).collect()}
    assert found == brute_windows(LABELS, [SHORT, ALT], 3) and len(found) == 16
    rng = random.Random(3)
    labels = {n: "ACGT"[: rng.randint(1, 4)] for n in range(1, 8)}
    walks = [[rng.choice([1, -1]) * rng.randint(1, 7) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    found = {r[0] for r in windows.haplotype_windows(build(spark, labels, walks), 5).select(windows.walk_text(F.col("nodes"))).collect()}
    assert found == brute_windows(labels, walks, 5)


def test_canonical_kmers_and_palindromes(spark):
    seqs = spark.createDataFrame([(1, "GATTACAGATTA"), (2, "ACGT"), (3, "AN"), (4, "")], "id int, seq string")
    found = rows(kmers.canonical_kmers(seqs, 3).where("id = 1").select("kmer", "is_rev", "offset"))
    want = [("ATC", True, 2), ("AAT", True, 3), ("TAA", True, 4), ("ACA", False, 4), ("GTA", True, 5), ("CAG", False, 5), ("AGA", False, 6), ("ATC", True, 9), ("AAT", True, 10), ("TAA", True, 11)]
    assert found == sorted(want)
    assert rows(kmers.canonical_kmers(seqs, 4).where("id = 2")) == [(2, "ACGT", True, 3)]
    assert kmers.canonical_kmers(seqs, 3).where("id > 2").count() == 0


def test_minimizers_syncmers_and_weights(spark):
    seqs = spark.createDataFrame([(1, "CGAATACAATACT")], "id int, seq string")
    pick = lambda df: sorted(((r["offset"], r["kmer"], r["is_rev"]) for r in df.collect()))
    assert pick(kmers.minimizers(seqs, 3, 2)) == [(2, "AAT", False), (2, "TCG", True), (5, "TAT", True), (7, "AAT", False), (7, "TGT", True), (10, "ACT", False), (10, "TAT", True)]
    assert pick(kmers.syncmers(seqs, 5, 3)) == [(2, "AATAC", False), (3, "ATACA", False), (4, "ATTCG", True), (5, "ACAAT", False), (7, "AATAC", False), (12, "AGTAT", True)]
    weighted = pick(kmers.minimizers(seqs, 3, 2, frequent=["ATA", "TAT"], rounds=3))
    assert weighted == [(2, "AAT", False), (2, "TCG", True), (4, "TAC", False), (7, "AAT", False), (7, "TGT", True), (9, "TAC", False), (10, "ACT", False)]
    with pytest.raises(ValueError):
        kmers.minimizers(seqs, 3, 0)


def test_index_positions_spell_their_kmers(spark, base):
    index = kmers.minimizer_index_with_paths(base, 3, 2)
    labels = {n: s for n, s in base.nodes.select("node_id", "seq").collect()}
    spelled = {0: "GGGGTACA", 1: "GAGGGTAAA"}
    for r in index.collect():
        first = labels[r["node_id"]].translate(str.maketrans("ACGT", "TGCA"))[::-1] if r["is_rev"] else labels[r["node_id"]]
        assert r["kmer"].startswith(first[r["offset"] : r["offset"] + 1])
        inside = [p for p, s in spelled.items() if r["kmer"] in s or r["kmer"][::-1].translate(str.maketrans("ACGT", "TGCA")) in s]
        assert inside
    frequent = {r["kmer"] for r in kmers.frequent_kmers(kmers.kmer_index(base, 3), 1).collect()}
    assert frequent == {"CCC", "GTA"}


def test_haplotype_ids_fall_back(base):
    assert sorted(r[0] for r in paths.haplotype_ids(base.paths).select("hap_id").collect()) == [0, 1, 2]
    assert {r[0] for r in paths.haplotype_ids(base.paths, most=2).select("hap_id").collect()} == {0}


def test_components_heads_order(spark):
    gr = build(spark, {n: "A" for n in range(1, 12)}, [[1, 2, 4], [1, 3, 4], [6, 7, -8, 6], [10]])
    ids = C.component_ids(gr)
    assert rows(ids.groupBy("component_id").count()) == [(1, 4), (6, 3), (10, 1)]
    assert rows(C.head_nodes(gr, ids)) == [(1, 1), (10, 10)]
    order = [tuple(r) for r in C.topological_order(gr, ids).where("component_id = 1").orderBy("position").select("node_id", "is_rev").collect()]
    at = {h: i for i, h in enumerate(order)}
    assert len(order) == 8 and all(at[a, False] < at[b, False] and at[b, True] < at[a, True] for a, b in ((1, 2), (1, 3), (2, 4), (3, 4)))
    assert [j for _, j, _ in rows(C.construction_jobs(ids, 0))] == [0, 1, 2]
    assert [j for _, j, _ in rows(C.construction_jobs(ids, 7))] == [0, 0, 1]
    assert [j for _, j, _ in rows(C.construction_jobs(ids, 8))] == [0, 0, 0]


def test_path_cover_covers_edges(spark):
    gr = build(spark, {n: "A" for n in range(1, 5)}, [[1, 2, 4], [1, 3, 4]])
    ids = C.component_ids(gr)
    made = {}
    for c, i, s, n, r in rows(cover.path_cover(gr, ids, n=4, k=3)):
        made.setdefault(i, []).append(n)
    assert {tuple(w) for w in made.values()} == {(1, 2, 4), (1, 3, 4)} and len(made) == 4
    local = {}
    for c, i, s, n, r in rows(cover.local_haplotypes(build(spark, {n: "A" for n in range(1, 5)}, [[1, 2, 4], [1, 2, 4], [1, 2, 4], [1, 3, 4]]), ids, n=4, k=3)):
        local.setdefault(i, []).append(n)
    assert sorted(map(tuple, local.values())) == [(1, 2, 4)] * 3 + [(1, 3, 4)]
    assert cover.path_cover(gr, ids, n=0).count() == 0
    assert cover.augment(gr, ids).count() == 0


def test_lcs_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(1, 5) for _ in range(rng.randint(0, 7))] for _ in range(2))
        best = 0
        for k in range(len(a) + 1):
            for pick in itertools.combinations(range(len(a)), k):
                it = iter(b)
                if all(a[i] in it for i in pick):
                    best = max(best, sum(a[i] for i in pick))
        got = path_lcs(a, b, lambda x: x)
        assert sum(a[i] for i, _ in got) == best
        assert all(a[i] == b[j] for i, j in got) and all(p < q for p, q in itertools.pairwise(got))


def test_cigars():
    label = {(1, False): "A", (2, False): "C", (3, False): "AA", (4, False): "CC", (5, False): "ACA", (6, False): "CAC"}.__getitem__
    walk = lambda *x: [(n, False) for n in x]
    assert to_cigar(align(walk(1), walk(2), label)) == "1M"
    assert to_cigar(align(walk(1, 2), walk(1), label)) == "1M1I"
    assert to_cigar(align(walk(3), walk(4), label)) == "2M"
    assert to_cigar(align([], walk(5), label)) == "3D"
    assert to_cigar(align(walk(5), walk(6), label)) == "3M"


def test_subgraph_of_a_bubble(spark):
    labels = {1: "G", 2: "A", 3: "T", 4: "T", 5: "A", 6: "C", 7: "A"}
    gr = build(spark, labels, [[1, 3, 4, 5, 7], [1, 2, 4, 5, 7], [1, 3, 4, 6, 7]], {0: "REFERENCE"})
    sub = U.path_offset_query(gr, "s0", "c", 1, 2, 1, U.DISTINCT)
    assert sub.to_gfa() == [
        "H\tVN:Z:1.1\tRS:Z:s0", "S\t2\tA", "S\t3\tT", "S\t4\tT", "S\t5\tA", "S\t6\tC",
        "L\t2\t+\t4\t+\t0M", "L\t3\t+\t4\t+\t0M", "L\t4\t+\t5\t+\t0M", "L\t4\t+\t6\t+\t0M",
        "W\ts0\t1\tc\t1\t4\t>3>4>5\tWT:i:1", "W\tunknown\t1\tc\t0\t3\t>2>4>5\tWT:i:1\tCG:Z:3M", "W\tunknown\t2\tc\t0\t3\t>3>4>6\tWT:i:1\tCG:Z:3M",
    ]
    only = U.path_offset_query(gr, "s0", "c", 1, 2, 1, U.REFERENCE_ONLY)
    assert len(only.walks) == 1
    assert len(U.node_query(gr, 4, 1).walks) == 3
    for bad in (lambda: U.path_offset_query(gr, "s0", "c", 1, 99, 1), lambda: U.path_offset_query(gr, "x", "c", 1, 0, 1), lambda: U.path_interval_query(gr, "s0", "c", 1, 3, 3, 1), lambda: U.node_query(gr, 4, 1, U.REFERENCE_ONLY)):
        with pytest.raises(ValueError):
            bad()


def test_lineage():
    a, b = lineage.GraphName("A"), lineage.GraphName("D")
    a.add_subgraph("A", "B")
    a.add_translation("B", "C")
    a.add_subgraph("A", "A")
    b.add_subgraph("C", "D")
    assert a.translates_to(b) and not a.is_subgraph_of(b) and not b.translates_to(a)
    assert lineage.GraphName.from_headers(a.gfa_headers()) == a == lineage.GraphName.from_headers(a.gaf_headers()) == lineage.GraphName.from_tags(a.to_tags())
    text = a.describe(b, "mine", "theirs")
    assert "Graph 2 translates to graph 3" in text and text.startswith("Name 1 is for mine")
    with pytest.raises(ValueError):
        lineage.GraphName.from_headers(["H\tSG:Z:only"])


def test_reachable_over_long_chains(spark):
    arcs = [("x", f"n{i}", f"n{i + 1}") for i in range(15)] + [("x", "n15", "n14"), ("y", "n3", "n3"), ("y", "n0", "n1")]
    found = {(r["src"], r["dst"]): r["hops"] for r in lineage.reachable(spark.createDataFrame(arcs, "kind string, src string, dst string")).collect()}
    want = {(f"n{i}", f"n{j}"): j - i for i in range(16) for j in range(i + 1, 16)}
    assert found == want | {("n15", "n14"): 1, ("n14", "n14"): 2, ("n15", "n15"): 2}


def test_restrict_and_merge(spark, base):
    short = g.restrict(base, F.col("path_id") != 1)
    assert short.edges.count() == 5 and g.sanity_checks(short) == []
    other = build(spark, {21: "A", 22: "C"}, [[21, 22]])
    both = g.merge([base, other])
    assert both.edges.count() == 10 and both.paths.select("path_id").distinct().count() == 4
    with pytest.raises(ValueError):
        g.merge([base, base])


GFA = ["H\tVN:Z:1.1\tRS:Z:ref", "S\ta\tgatta", "S\tb\tCA", "S\tc\tT", "# a comment", "L\ta\t+\tb\t+\t*", "P\tgen\ta+,b-\t*", "W\tref\t0\tchr1\t0\t8\t>a>b>c", "W\ts1\t1\tchr1\t*\t*\t>a<b", "Z\ts2\t1\tchr1\t0\t8\t>q", "Q\tq\t>a<r", "Q\tr\t>c<b"]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_gfa_in_and_out(spark, tmp_path):
    gr = gfa.from_gfa(spark, write(tmp_path / "x.gfa", GFA), max_node_length=3)
    assert rows(gr.nodes.select("node_id", "seq")) == [(1, "GAT"), (2, "TA"), (3, "CA"), (4, "T")]
    assert rows(gr.segments) == [("a", 1, 3), ("b", 3, 4), ("c", 4, 5)]
    walks = {}
    for p, s, n, r in rows(gr.steps):
        walks.setdefault(p, []).append(-n if r else n)
    # >q is >a<r, and <r reads >c<b backwards: >b<c.
    assert walks == {0: [1, 2, -3], 1: [1, 2, 3, 4], 2: [1, 2, -3], 3: [1, 2, 3, -4]}
    assert [r[0] for r in sorted(gr.paths.select("path_id", "sense").collect())] == [0, 1, 2, 3]
    out = [r["line"] for r in gfa_out.gfa_lines(gr).orderBy("part", "k1", "k2").collect()]
    assert out == [
        "H\tVN:Z:1.1\tRS:Z:ref", "S\ta\tGATTA", "S\tb\tCA", "S\tc\tT", "L\ta\t+\tb\t+\t0M", "L\ta\t+\tb\t-\t0M", "L\tb\t+\tc\t+\t0M", "L\tb\t+\tc\t-\t0M",
        "P\tgen\ta+,b-\t*", "W\tref\t0\tchr1\t0\t8\t>a>b>c", "W\ts1\t1\tchr1\t0\t7\t>a<b", "W\ts2\t1\tchr1\t0\t8\t>a>b<c",
    ]
    assert sorted(r["line"] for r in gfa_out.translation_table(gr).collect()) == ["T\ta\t1,2", "T\tb\t3", "T\tc\t4"]
    again = gfa.from_gfa(spark, write(tmp_path / "y.gfa", out), max_node_length=3)
    assert rows(again.steps) == rows(gr.steps)
    with pytest.raises(ValueError):
        gfa_out.path_text(gr, "other")


def test_gfa_keeps_integer_names(spark, tmp_path):
    gr = gfa.from_gfa(spark, write(tmp_path / "i.gfa", ["S\t11\tA", "S\t12\tC", "S\t13\tG", "W\tx\t1\tc\t0\t2\t>11<12"]))
    assert gr.segments is None and rows(gr.edges) == [(11, False, 12, True)]
    assert rows(gr.nodes.select("node_id")) == [(11,), (12,)]


@pytest.mark.parametrize("bad", [["S\ta\tA"], ["W\tx\t1\tc\t0\t1\t>a"], ["S\ta\t", "P\tp\ta+\t*"], ["S\ta\tA", "P\tp\ta\t*"], ["S\ta\tA", "P\tp\tb+\t*"], ["S\ta\tA", "S\ta\tC", "P\tp\ta+\t*"], ["S\ta\tA", "Z\tx\t1\tc\t0\t1\t>q", "Q\tq\t>a>q"], ["S\ta\tA", "Z\tx\t1\tc\t0\t1\t>q", "Q\tq\t>a>z"], ["H\tno", "S\ta\tA", "P\tp\ta+\t*"]])
def test_gfa_errors(spark, tmp_path, bad):
    with pytest.raises(Exception):  # noqa: B017
        gfa.from_gfa(spark, write(tmp_path / "bad.gfa", bad)).steps.collect()


def test_path_name_formats(spark, tmp_path):
    lines = ["S\t1\tA", "P\ts#1#chr\t1+\t*", "P\tplain\t1+\t*"]
    gr = gfa.from_gfa(spark, write(tmp_path / "f.gfa", lines), path_formats=(gfa.PAN_SN, gfa.ANY_NAME))
    assert rows(gr.paths.select("sample", "contig", "haplotype")) == [("_gbwt_ref", "plain", None), ("s", "chr", 1)]


def test_store_round_trip(spark, tmp_path, base):
    store.save(base, str(tmp_path / "g"))
    again = store.load(spark, str(tmp_path / "g"))
    assert rows(again.steps) == rows(base.steps.select("path_id", "step", "node_id", "is_rev")) and again.segments is None
    assert lineage.compute_name(again) == lineage.compute_name(base)


def test_segments_without_translation(base):
    assert rows(segments.node_segments(base).where("node_id = 4").select("name", "node_lo", "node_hi")) == [("4", 4, 5)]


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTN", "aRyX")], "a string, b string")
    row = df.select(dna.reverse_complement("a"), dna.reverse_complement("b"), dna.kmer_key(F.lit("ACGT")), dna.kmer_key(F.lit("ACN"))).first()
    assert tuple(row) == ("NACGT", "NrYt", 27, None)


def test_senses_and_references(base):
    assert paths.set_senses(["a"], {"b": "REFERENCE", "a": "HAPLOTYPE"}) == ["b"]
    with pytest.raises(ValueError):
        paths.set_senses([], {"a": "GENERIC"})
    changed, n = paths.set_reference_samples(base, ["s1", "nobody"])
    assert n == 1 and changed.tags["reference_samples"] == "s1"
    assert rows(changed.paths.where("sense = 'REFERENCE'").select("sample")) == [("s1",)]
    assert paths.matching(base.paths, samples=set()).count() == 0 and paths.matching(base.paths).count() == 3


def test_line_numbers_of_errors(spark, tmp_path):
    good = ["H\tVN:Z:1.1", "# a comment", "S\ta\tA", "S\tb\tC", "L\ta\t+\tb\t-\t0M", "P\tp\ta+,b-\t*"]
    assert rows(gfa.from_gfa(spark, write(tmp_path / "good.gfa", good)).edges) == [(1, False, 2, True)]
    for at, line, what in [(4, "L\ta\t+\tb\tx\t0M", "no orientation"), (4, "L\ta\t+\tzz\t-\t0M", "no segment zz"), (4, "L\ta\t+", "no segment name"), (5, "P\tp\ta+,b\t*", "no list"), (5, "W\tx\t1\tc\tq\t2\t>a", "no haplotype or start"), (0, "H\tVN", "malformed header")]:
        bad = [line if i == at else x for i, x in enumerate(good)] + (["P\tq\ta+\t*"] if line[0] == "W" else [])
        with pytest.raises(gfa.GfaError, match=f"line {at + 1}: {what}"):
            gfa.from_gfa(spark, write(tmp_path / f"bad{at}{line[-2:].strip()}.gfa", bad))
    with pytest.warns(UserWarning, match="unknown version 9"):
        gfa.from_gfa(spark, write(tmp_path / "v.gfa", ["H\tVN:Z:9", *good[2:]]))


def test_paths_in_job_order(spark, tmp_path):
    segments = [f"S\t{i}\tA" for i in (11, 12, 13, 21, 22, 31)]
    links = ["L\t11\t+\t12\t+\t0M", "L\t12\t+\t13\t+\t0M", "L\t21\t+\t22\t+\t0M"]
    walks = ["W\tx\t1\tc\t0\t1\t>31", "W\tx\t1\tb\t0\t2\t>21>22", "W\tx\t1\ta\t0\t2\t>11>12", "P\tp\t22+\t*", "W\ty\t1\ta\t0\t2\t>12>13"]
    path = write(tmp_path / "jobs.gfa", [*segments, *links, *walks])
    contigs = lambda gr: [r["contig"] + r["sample"][:1] for r in gr.paths.orderBy("path_id").collect()]
    assert contigs(gfa.from_gfa(spark, path)) == ["p_", "cx", "bx", "ax", "ay"]
    assert contigs(gfa.from_gfa(spark, path, jobs=6)) == ["ax", "ay", "p_", "bx", "cx"]  # a job each
    assert contigs(gfa.from_gfa(spark, path, jobs=2)) == ["ax", "ay", "p_", "cx", "bx"]  # {11..13}, {21..22, 31}


def test_path_modes_and_missing_haplotypes(spark):
    gr = build(spark, {1: "A", 2: "C"}, [[1, 2], [1, -2], [2]], {0: "REFERENCE", 1: "GENERIC"})
    gr.paths = gr.paths.withColumn("haplotype", F.when(F.col("path_id") == 1, None).otherwise(F.when(F.col("path_id") == 0, F.lit(None)).otherwise(F.col("haplotype"))).cast("bigint"))
    text = lambda mode: sorted(r["line"].split("\t")[0] for r in gfa_out.path_text(gr, mode).collect())
    assert text("default") == ["P", "W", "W"] and text("ref-only") == ["P", "W"] and text("pan-sn") == ["P", "P", "P"]
    (walk,) = (r["line"] for r in gfa_out.path_text(gr, "ref-only").collect() if r["line"][0] == "W")
    assert walk.split("\t")[2] == gfa_out.NO_PHASE


def test_find_path_by_composed_name(spark):
    fields = "path_id bigint, sample string, contig string, haplotype bigint, fragment bigint, sense string"
    p = spark.createDataFrame([(0, "ref", "chr1", 0, 0, "REFERENCE"), (1, "s", "chr1", 1, 7, "HAPLOTYPE"), (2, "s", "a#b", 2, 0, "HAPLOTYPE"), (3, "_gbwt_ref", "x#1#y#2", None, 0, "GENERIC")], fields)
    found = lambda name: [r["path_id"] for r in P.find_path(p, name).collect()]
    assert found("ref#0#chr1") == [0] and found("s#1#chr1#7") == [1] and found("s#2#a#b#0") == [2] and found("x#1#y#2") == [3]
    assert found("s#1#chr1") == found("s#1#chr1#8") == found("ref#0#chr1#0") == found("nothing") == []
    assert {r["path_id"]: r["handle"] for r in P.path_handles(p).collect()} == {0: 0, 3: 1, 1: 3, 2: 4}


def wang(x):
    m = 2**64
    x = (~x + (x << 21)) % m
    x ^= x >> 24
    x = (x * 265) % m
    x ^= x >> 14
    x = (x * 21) % m
    x ^= x >> 28
    return (x + (x << 31)) % m


@pytest.mark.parametrize(("k", "w", "s", "bits"), [(5, 3, 3, 64), (31, 4, 20, 64), (5, 3, 3, 128), (39, 5, 24, 128), (63, 2, 35, 128)])
def test_schemes_against_plain_ones(k, w, s, bits):
    rng = random.Random(k)
    text = "".join(rng.choice("ACGT") for _ in range(200)) + "N" + "".join(rng.choice("ACGTacgt") for _ in range(90)) + "ACACACAC" * 20
    comp = str.maketrans("ACGT", "TGCA")

    def hashed(x):
        key = int(x.translate(str.maketrans("ACGT", "0123")), 4)
        if bits == 64:
            return wang(key)
        h = wang(key >> 64)
        return h ^ (wang(key % 2**64) + 0x9E3779B9 + (h << 6) + (h >> 2)) % 2**64

    def at(i, n):
        x = text[i : i + n].upper()
        return None if "N" in x or len(x) < n else (hashed(x), hashed(x.translate(comp)[::-1]))

    want = {}
    for a in range(len(text) - k - w + 2):
        some = {i: h for i in range(a, a + w) if (h := at(i, k))}
        for i, h in some.items():
            if min(h) == min(map(min, some.values())):
                want.setdefault(i, [h[1] < h[0], a, a])[2] = a
    assert [(p, r, a, b) for p, r, _, a, b in kmers.minimizers_of(text, k, w, bits=bits)] == [(p, *v) for p, v in sorted(want.items())]
    closed = []
    for i in range(len(text) - k + 1):
        if h := at(i, k):
            inner = [min(at(i + j, s)) for j in range(k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                closed.append((i, h[1] < h[0]))
    assert kmers.syncmers_of(text, k, s, bits) == closed


def test_index_tables(spark, tmp_path):
    hits = spark.createDataFrame([("ACG", 1, False, 0), ("CCC", 2, True, 3)], "kmer string, node_id bigint, is_rev boolean, offset int")
    store.save_index(hits, "hits_of_a_test", {"k": "3", "pggname": "it's \\ x"}, buckets=2)
    try:
        again, tags = store.load_index(spark, "hits_of_a_test", {"k": 3})
        assert kmers.same_index(hits, again) and tags == {"k": "3", "pggname": "it's \\ x"}
        with pytest.raises(ValueError):
            store.load_index(spark, "hits_of_a_test", {"k": 4})
        assert not kmers.same_index(hits, again.limit(1))
    finally:
        spark.sql("DROP TABLE hits_of_a_test")


def test_two_stores(spark, tmp_path, base):
    store.save(base, str(tmp_path / "whole"))
    bare = HapGraph(base.nodes.limit(0), base.paths, base.steps)
    store.save(bare, str(tmp_path / "bare"))
    assert rows(store.load_two(spark, str(tmp_path / "bare"), str(tmp_path / "whole")).edges) == rows(base.edges)
    with pytest.raises(ValueError):
        store.load_two(spark, str(tmp_path / "whole"), str(tmp_path / "bare"))


def test_imported_translations(spark):
    nodes = spark.createDataFrame([(i, 2) for i in (1, 2, 3, 5, 6)], "node_id bigint, len bigint")
    fields = "node_id bigint, name string, is_rev boolean, offset bigint"
    told = [(1, "a", False, 0), (2, "a", False, 2), (3, "b", False, 0), (5, "c", False, 0), (6, "c", False, 2)]
    assert rows(segments.from_translation(nodes, spark.createDataFrame(told, fields))) == [("a", 1, 3), ("b", 3, 4), ("c", 5, 7)]
    for bad in ([*told[:4], (6, "c", False, 1)], [*told[:4], (6, "c", True, 2)], told[:4], [*told, told[0]]):
        with pytest.raises(ValueError):
            segments.from_translation(nodes, spark.createDataFrame(bad, fields))


def test_named_paths_before_a_cover(spark):
    labels = {i: "ACGT"[i % 4] for i in range(1, 8)}
    gr = build(spark, labels, [[1, 2, 4], [1, 3, 4], [5, 6, 7]], {0: "REFERENCE"})
    ids = C.component_ids(gr)
    both = cover.named_and_cover(gr, ids, cover.path_cover(gr, ids, n=2, k=2))
    got = {r["path_id"]: (r["sample"], r["contig"]) for r in both.paths.collect()}
    assert got == {0: ("s0", "c"), 3: ("path_cover_0", "c"), 4: ("path_cover_1", "c"), 5: ("path_cover_0", "component_1"), 6: ("path_cover_1", "component_1")}
    assert {r["path_id"] for r in both.steps.collect()} == set(got)


def test_search_meets_nodes_in_order(spark):
    rng = random.Random(12)
    labels = {i: "A" * rng.randint(1, 6) for i in range(1, 31)}
    gr = build(spark, labels, [[rng.choice([1, -1]) * rng.randint(1, 30) for _ in range(12)] for _ in range(6)])
    succ = {}
    for a, ar, b, br in rows(gr.edges_bi):
        succ.setdefault((a, ar), []).append((b, br))
    for context in (0, 3, 9, 25):
        found, queue = [], [(0, 5, False, len(labels[5]) // 2)]
        while queue:
            d, n, r, o = queue.pop(queue.index(min(queue)))
            if n not in found:
                found.append(n)
                for side in (False, True):
                    e = d + (len(labels[n]) - o if side == r else o + 1)
                    queue += [(e, b, br, 0) for b, br in succ.get((n, side), []) if e <= context]
        got = U.nodes_within(gr, (5, False, len(labels[5]) // 2), context)
        assert sorted(r[0] for r in got.collect()) == sorted(found)


def test_search_takes_no_edges_to_one_task(spark, monkeypatch):
    """A ring whose whole length is within the context: nodes are met on both ways round, and no task gets the edges of all."""

    def whole(*_):
        raise AssertionError("a task of all edges")

    monkeypatch.setattr(GroupedData, "applyInPandas", whole)
    gr = build(spark, {i: "AC" for i in range(1, 13)}, [[*range(1, 13), 1]])
    assert rows(U.nodes_within(gr, (1, False, 0), 5)) == [(n,) for n in (1, 2, 3, 10, 11, 12)]
    assert rows(U.nodes_within(gr, (1, False, 0), 40)) == [(n,) for n in range(1, 13)]


def test_subgraph_lines_are_made_in_spark(spark, monkeypatch):
    labels = {1: "G", 2: "A", 3: "T", 4: "TC", 5: "A", 6: "C", 7: "A"}
    gr = build(spark, labels, [[1, 3, 4, 5, 7], [1, 2, 4, 5, 7], [-7, -5, -4, -3, -1], [1, 3, 4, 6, 7], [-5, -4, -2]], {0: "REFERENCE"})
    asked = [(sample, at, 1) for sample, at in (("s0", 2), ("s2", 2))]
    wanted = {(x, out): U.path_offset_query(gr, x[0], "c", 1, *x[1:], out).to_gfa() for x in asked for out in (U.ALL, U.DISTINCT, U.REFERENCE_ONLY)}
    found = {x: U.around_offset(gr, x[0], "c", 1, *x[1:]) for x in asked}
    monkeypatch.setattr(U, "Subgraph", None)  # the object that holds all of it
    for (x, out), lines in wanted.items():
        assert rows(U.gfa_lines(gr, found[x], out)) == list(enumerate(lines))


def test_schemes_over_batches_of_texts(spark):
    """All texts of a batch are one array: no k-mer or window goes from one text into the next."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTacgtN" if i % 3 else "ACGT") for _ in range(rng.randint(0, 30))) for i in range(80)] + ["", "A", "ACGTACG"]
    joined = kmers._Texts(texts)
    for k, w in ((3, 1), (5, 4), (7, 12)):
        at, hf, hr, first, last = kmers._minimizers(joined, k, w)
        own, start = joined.text[at], joined.start[joined.text[at]]
        got = list(zip(own.tolist(), (at - start).tolist(), (hr < hf).tolist(), (first - start).tolist(), (last - start).tolist()))
        assert got == [(i, p, r, a, b) for i, t in enumerate(texts) for p, r, _, a, b in kmers.minimizers_of(t, k, w)]
        at, is_rev = kmers._syncmers(joined, k, 2)
        assert list(zip(joined.text[at].tolist(), (at - joined.start[joined.text[at]]).tolist(), is_rev.tolist())) == [(i, *x) for i, t in enumerate(texts) for x in kmers.syncmers_of(t, k, 2)]
    table = spark.createDataFrame([*enumerate(texts), (1000, None)], "id bigint, seq string").repartition(2)
    spelt = {(i, x, r, o) for i, x, r, o in rows(kmers.minimizers(table, 5, 4))}
    back = lambda t: t.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert spelt and all(x == (back(texts[i][o - 4 : o + 1].upper()) if r else texts[i][o : o + 5].upper()) for i, x, r, o in spelt)


def test_indexes_come_from_the_surroundings_of_nodes(spark, monkeypatch):
    """All hits of all paths on both strands, against a plain version; no window is made, and bitmaps of one shared id need no lookup of walks."""

    def windows_of(*_):
        raise AssertionError("windows")

    monkeypatch.setattr(kmers, "haplotype_windows", windows_of)
    rng = random.Random(8)
    labels = {i: "".join(rng.choice("ACGTN" if i == 7 else "ACGT") for _ in range(rng.randint(1, 9))) for i in range(1, 15)}
    walks = [[rng.choice([1, 1, -1]) * rng.randint(1, 14) for _ in range(rng.randint(1, 9))] for _ in range(12)]
    back = lambda t: t.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    gr = build(spark, labels, walks)
    strands = []  # texts with the node, orientation and offset of each base
    for walk in walks + [[-n for n in reversed(w)] for w in walks]:
        spelt = [(back(labels[-n]) if n < 0 else labels[n], abs(n), n < 0) for n in walk]
        strands.append(("".join(t for t, *_ in spelt), [(n, r, i) for t, n, r in spelt for i in range(len(t))]))
    place = lambda at, o, is_rev: (at[o][0], not at[o][1], len(labels[at[o][0]]) - 1 - at[o][2]) if is_rev else at[o]
    for k, w in ((4, 3), (5, 2), (3, 6)):
        every, least = set(), set()
        for text, at in strands:
            for p in range(len(text) - k + 1):
                fwd, rev = text[p : p + k], back(text[p : p + k])
                if "N" not in fwd:
                    every.add((min(fwd, rev), *place(at, p + k - 1 if rev <= fwd else p, rev <= fwd)))
            for p, r, *_ in kmers.minimizers_of(text, k, w):
                least.add((back(text[p : p + k]) if r else text[p : p + k], *place(at, p + k - 1 if r else p, r)))
        assert rows(kmers.kmer_index(gr, k)) == sorted(every)
        assert rows(kmers.minimizer_index(gr, k, w)) == sorted(least)
        monkeypatch.setattr(kmers, "too_many_haplotypes", lambda _: True)
        assert rows(kmers.minimizer_index_with_paths(gr, k, w)) == sorted((*x, 1) for x in least)


def _plain_heads(nodes, succ, indegree):
    heads = sorted(n for n in nodes if not indegree.get((n, False)))
    left, side, active, freed = {}, dict.fromkeys(heads, False), [(n, False) for n in heads], len(heads)
    while active:
        for nxt, rev in succ.get(active.pop(), ()):
            if nxt not in side:
                side[nxt], left[nxt] = rev, indegree.get((nxt, rev), 0)
            elif side[nxt] != rev or nxt not in left:
                return []
            left[nxt] -= 1
            if left[nxt] == 0:
                active.append((nxt, rev))
                freed += 1
    return heads if freed == len(nodes) else []


def _plain_order(nodes, succ, indegree):
    degree = {(n, r): indegree.get((n, r), 0) for n in nodes for r in (False, True)}
    level, out = sorted(h for h, d in degree.items() if d == 0), []
    while level:
        out, freed = out + level, []
        for h in level:
            for b in succ.get(h, ()):
                degree[b] -= 1
                freed += [b] * (degree[b] == 0)
        level = sorted(freed)
    return out if len(out) == len(degree) else []


def _plain_cover(nodes, succ, heads, n, k, visits):
    node, window = Counter(), Counter()
    flip = lambda w: tuple((x, not r) for x, r in reversed(w))
    count = lambda w: sum(v[i : i + len(w)] == w for v in visits for i in range(len(v)))
    cost = lambda chosen, w: chosen if visits is None else -count(w) / (chosen + 1)
    starts = [x for x in heads or nodes if visits is None or count(((x, False),))]
    made = []
    for _ in range(n if starts else 0):
        first = min(starts, key=lambda x: (cost(node[x], ((x, False),)), x))
        node[first] += 1
        path, going = ((first, False),), True
        while going and len(path) < len(nodes):
            going = False
            for forward in (True, False) if not heads else (True,):
                if len(path) >= len(nodes):
                    break
                near = succ.get(path[-1], ()) if forward else [flip([h])[0] for h in succ.get(flip(path[:1])[0], ())]
                walks = [(*path[-(k - 1) :], h) if forward else (h, *path[: k - 1]) for h in sorted(near)]
                walks = [(w, w[-1] if forward else w[0]) for w in walks if visits is None or count(w)]
                by_node = not heads and len(path) + 1 < k
                if not walks:
                    continue
                w, h = min(walks, key=lambda x: cost(node[x[1][0]], (x[1],)) if by_node else cost(window[min(x[0], flip(x[0]))], x[0]))
                window[min(w, flip(w))] += not by_node
                node[h[0]] += not heads
                path, going = (*path, h) if forward else (h, *path), True
        made.append(list(path))
    return made


def test_component_work_against_plain_versions():
    """Heads, orders and covers from arrays of handles."""
    rng, seen = random.Random(21), set()
    for case in range(150):
        n, acyclic = rng.randint(1, 9), case % 2
        walks = [sorted(rng.sample(range(1, n + 1), rng.randint(1, n))) if acyclic else [rng.choice([1, 1, -1]) * rng.randint(1, n) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 5))]
        walks = [[(abs(x), x < 0) for x in w] for w in walks]
        both = [tuple(w) for w in walks] + [tuple((x, not r) for x, r in reversed(w)) for w in walks]
        edges = {e for w in both for e in zip(w, w[1:])}
        succ, indegree = {}, Counter(b for _, b in edges)
        for a, b in sorted(edges):
            succ.setdefault(a, []).append(b)
        nodes = sorted({x for w in walks for x, _ in w})
        code = lambda h: 2 * h[0] + h[1]
        flipped = lambda e: tuple((x, not r) for x, r in reversed(e))
        once = np.array([[code(h) for h in e] for e in sorted(edges) if e <= flipped(e)], np.int64).reshape(-1, 2)
        ways = C.Ways(np.array(nodes), once[:, 0], once[:, 1])
        heads, order = _plain_heads(nodes, succ, indegree), _plain_order(nodes, succ, indegree)
        assert C.heads_of(ways) == heads and C.order_of(ways).tolist() == [code(h) for h in order]
        at = np.array([(p, s, code(h)) for p, w in enumerate(walks) for s, h in enumerate(w)])
        flat = cover._flat(*rng_permuted(rng, at).T)
        for k in (2, 3):
            assert cover.greedy_paths(ways, 3, k) == [[code(h) for h in w] for w in _plain_cover(nodes, succ, heads, 3, k, None)]
            assert cover.greedy_paths(ways, 3, k, flat) == [[code(h) for h in w] for w in _plain_cover(nodes, succ, heads, 3, k, both)]
        seen.add((bool(heads), bool(order)))
    assert len(seen) >= 3


def rng_permuted(rng, rows_):
    order = list(range(len(rows_)))
    rng.shuffle(order)
    return rows_[order]


def test_component_ids_are_computed_once(spark):
    gr = build(spark, {n: "A" for n in range(1, 8)}, [[5, 1, -5], [2, 6], [6, 3], [7]])
    ids = C.component_ids(gr)
    assert ids._settled_at and rows(ids) == [(1, 1), (2, 2), (3, 2), (5, 1), (6, 2), (7, 7)]


def test_names_are_hashed_in_a_task(spark, base, monkeypatch):
    text = "".join(r["line"] + "\n" for r in lineage.canonical_gfa(base).collect())

    def rows_to_driver(*_, **__):
        raise AssertionError("the text goes through the driver")

    monkeypatch.setattr(type(base.steps), "toLocalIterator", rows_to_driver)
    wanted = hashlib.sha256(text.encode()).hexdigest()
    for size in (3, 16_384):
        monkeypatch.setattr(lineage, "PIECE", size)
        assert lineage.compute_name(base) == wanted
    assert lineage.compute_name(build(spark, {1: "A"}, [[1]])) == hashlib.sha256(b"S\t1\tA\n").hexdigest()
    cut = lambda *at: pa.RecordBatch.from_arrays([pa.array(at), pa.array([b"%d" % i for i in at])], ["i", "text"])
    (found,) = lineage._digest(iter([cut(1, 0), cut(4, 5, 3), cut(2)]))
    assert found.column(0)[0].as_py() == hashlib.sha256(b"012345").hexdigest()
    with pytest.raises(RuntimeError):
        list(lineage._digest(iter([cut(0, 2)])))
    assert list(lineage._digest(iter([]))) == []


def test_pattern_search_counts_windows_as_they_are_cut(spark, monkeypatch):
    def lookup(*_):
        raise AssertionError("a lookup of walks")

    rng = random.Random(3)
    labels = {i: "".join(rng.choice("ACG") for _ in range(rng.randint(1, 6))) for i in range(1, 9)}
    walks = [[rng.choice([1, 1, -1]) * rng.randint(1, 8) for _ in range(rng.randint(1, 6))] for _ in range(25)]
    gr = build(spark, labels, walks)
    back = lambda t: t.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    strands = walks + [[-n for n in reversed(w)] for w in walks]
    monkeypatch.setattr(windows, "visits_of", lookup)
    for pattern in ("AC", "CAG"):
        made = [[-n if r else n for n, r, _ in x["nodes"]] for x in windows.nonredundant_windows(gr, len(pattern)).collect()]
        wanted = []
        for w in made:
            seq = "".join(back(labels[-n]) if n < 0 else labels[n] for n in w)
            if pattern in seq:
                visits = sum(s[i : i + len(w)] == w for s in strands for i in range(len(s)))
                wanted.append(("".join(f"{'<' if n < 0 else '>'}{abs(n)}" for n in w), len(w), seq, seq.index(pattern), visits))
        assert wanted and rows(windows.pattern_search(gr, pattern)) == sorted(wanted)


def test_counts_over_a_stream(spark, tmp_path, base):
    base.steps.repartition(3).write.parquet(str(tmp_path / "steps"))
    stream = spark.readStream.schema(base.steps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "steps"))
    for name, f in (("visits", incremental.visit_counts), ("totals", incremental.path_totals)):
        running = f(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert running.awaitTermination(120)
        assert rows(spark.table(name)) == rows(f(base.steps))


@pytest.mark.parametrize("large", [0, 10**6])
def test_components_of_one_giant_star_and_chains(spark, monkeypatch, large):
    monkeypatch.setattr(stars, "LARGE", large)
    links = [(1000, i) for i in range(200)] + [(i, i + 1) for i in range(2000, 2070)] + [(5, 5), (None, 1), (7, None)]
    found = dict(tuple(r) for r in stars.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert found == {**dict.fromkeys([*range(200), 1000], 0), **dict.fromkeys(range(2000, 2071), 2000)}


def test_components_split_a_hot_root(spark, monkeypatch):
    """With written tables adaptive execution splits the key that all links of a component have."""
    monkeypatch.setattr(stars, "LARGE", 0)
    join = stars.settle
    tight = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in tight}
    for k, v in tight.items():
        spark.conf.set(k, v)
    try:
        links = spark.range(60_000).select(F.lit(0).cast("bigint").alias("a"), (F.col("id") + 1).alias("b"))
        assert stars.components(links).groupBy("root").count().collect() == [(0, 60_001)]
        arcs = join(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = join(arcs.groupBy("u").agg(F.min("v").alias("m")))
        joined = arcs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
