"""Queries on windows, minimizers, components, subgraphs, alignments, covers, names and GFA text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plait.functions import dna
from plait.functions.alignment import align, path_lcs, to_cigar
from plait.operators import components as C
from plait.operators import cover, kmers, lineage, paths, windows
from plait.operators import graph as g
from plait.operators import subgraph as U
from plait.plans.driver_view import graph, layers, sql
from plait.sources import gfa, gfa_out
from plait.storage import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Windows.

W = 12
_WINDOWS = """, b AS (SELECT s.*, n.len FROM steps_bi s JOIN nodes n USING (node_id)),
    ahead AS (SELECT row_number() OVER () AS rid, len, list({{'t': (CASE WHEN is_rev THEN '<' ELSE '>' END) || node_id, 'len': len}})
        OVER (PARTITION BY path_id, ori ORDER BY step ROWS BETWEEN CURRENT ROW AND {2} FOLLOWING) AS x FROM b),
    each AS (SELECT rid, len, len(x) AS total, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM ahead),
    cum AS (SELECT rid, i, total, {0} AS base, {1} AS target, v.t AS t,
        ({0}) + sum(CASE WHEN i = 1 THEN 0 ELSE v.len END) OVER (PARTITION BY rid ORDER BY i) AS bp,
        string_agg(v.t, '' ) OVER (PARTITION BY rid ORDER BY i) AS walk FROM each),
    ends AS (SELECT rid, min(i) FILTER (bp >= target) AS n, max(i) AS last FROM cum GROUP BY rid),
    cut AS (SELECT c.walk, c.bp >= c.target AS reached, c.bp FROM cum c JOIN ends e ON c.rid = e.rid AND c.i = coalesce(e.n, e.last)),
    win AS (SELECT DISTINCT walk FROM cut WHERE reached UNION SELECT walk FROM cut WHERE NOT reached AND bp >= {3}
        AND walk NOT IN (SELECT walk FROM cum WHERE i < total))"""


def _all_windows(w: int) -> str:
    return _WINDOWS.format("len", f"len + {w - 1}", w, w)


_Q7 = _all_windows(W)
def _nonredundant(w: int) -> str:
    """The windows of pattern length w or more, before single nodes."""
    return _WINDOWS.format(f"CASE WHEN len >= {w} THEN {w - 1} ELSE len END", f"CASE WHEN len >= {w} THEN {2 * (w - 1)} ELSE len + {w - 1} END", 2 * w, w)


_Q8 = _nonredundant(W)
_ALONE = f" SELECT walk FROM win UNION SELECT (CASE WHEN is_rev THEN '<' ELSE '>' END) || node_id FROM b WHERE len >= {W}"


@query(sql(_Q7 + " SELECT walk FROM win"))
def haplotype_windows(spark, sf):
    return windows.haplotype_windows(graph(spark, sf), W).select(windows.walk_text(F.col("nodes")).alias("walk"))


@query(sql(_Q8 + _ALONE))
def nonredundant_windows(spark, sf):
    return windows.nonredundant_windows(graph(spark, sf), W).select(windows.walk_text(F.col("nodes")).alias("walk"))


PATTERN = "ACTACA"
#: Windows as text, and their nodes in order with label and place in the window.
_SPELT = """, spelt AS (SELECT walk, i, substr(t, 1, 1) = '<' AS is_rev, substr(t, 2)::BIGINT AS node_id
        FROM (SELECT walk, unnest(regexp_extract_all(walk, '[<>][0-9]+')) AS t, unnest(range(len(regexp_extract_all(walk, '[<>][0-9]+')))) AS i FROM w)),
    parts AS (SELECT s.*, h.oseq, h.len, sum(h.len) OVER (PARTITION BY walk ORDER BY i) - h.len AS start FROM spelt s JOIN handles h ON h.node_id = s.node_id AND h.is_rev = s.is_rev),
    read AS (SELECT walk, count(*)::INTEGER AS n_nodes, string_agg(oseq, '' ORDER BY i) AS seq FROM parts GROUP BY walk)"""


@query(sql(f"""{_nonredundant(len(PATTERN))}, w AS (SELECT walk FROM win UNION SELECT (CASE WHEN is_rev THEN '<' ELSE '>' END) || node_id FROM b WHERE len >= {len(PATTERN)}) {_SPELT},
    hit AS (SELECT * FROM read WHERE contains(seq, '{PATTERN}')),
    sides AS (SELECT path_id, ori, step, list((CASE WHEN is_rev THEN '<' ELSE '>' END) || node_id) OVER (PARTITION BY path_id, ori ORDER BY step ROWS BETWEEN CURRENT ROW AND {2 * len(PATTERN)} FOLLOWING) AS ts FROM steps_bi)
    SELECT h.walk, h.n_nodes, h.seq, (instr(h.seq, '{PATTERN}') - 1)::INTEGER AS "at", count(*) AS n_haplotypes
    FROM hit h JOIN sides s ON s.ts[1] = regexp_extract(h.walk, '^[<>][0-9]+') AND array_to_string(s.ts[1:h.n_nodes], '') = h.walk GROUP BY ALL"""))
def pattern_search(spark, sf):
    return windows.pattern_search(graph(spark, sf), PATTERN)


@query(sql(""", r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY path_id, step) AS k FROM placed JOIN paths USING (path_id) WHERE sample = '_gbwt_ref')
    SELECT node_id, (CASE WHEN is_rev THEN '<' ELSE '>' END) || contig || '#' || bp_offset::BIGINT AS label FROM r WHERE k = 1"""))
def reference_positions(spark, sf):
    return windows.reference_positions(graph(spark, sf), paths.GENERIC_SAMPLE)


# Hashes and minimizers of node labels.


def _wang(x: str, source: str, out: str) -> str:
    """CTEs h1 .. h7 of Wang's hash of column x of a table; HUGEINT, as 64-bit additions would overflow."""
    m = "18446744073709551616::HUGEINT"
    steps = [
        f"{out}1 AS (SELECT *, (({m} - 1 - {x}::HUGEINT) + ({x}::HUGEINT * 2097152) % {m}) % {m} AS h FROM {source})",
        f"{out}2 AS (SELECT * REPLACE (xor(h, h // 16777216) AS h) FROM {out}1)",
        f"{out}3 AS (SELECT * REPLACE ((h * 265) % {m} AS h) FROM {out}2)",
        f"{out}4 AS (SELECT * REPLACE (xor(h, h // 16384) AS h) FROM {out}3)",
        f"{out}5 AS (SELECT * REPLACE ((h * 21) % {m} AS h) FROM {out}4)",
        f"{out}6 AS (SELECT * REPLACE (xor(h, h // 268435456) AS h) FROM {out}5)",
        f"{out} AS (SELECT * REPLACE ((h + (h * 2147483648) % {m}) % {m} AS h) FROM {out}6)",
    ]
    return ", " + ", ".join(steps)


@query(sql(_wang("node_id", "nodes", "w") + " SELECT node_id, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS hash FROM w"))
def wang_hash(spark, sf):
    return graph(spark, sf).nodes.select("node_id", dna.wang_hash_64("node_id").alias("hash"))


K, S_, MW = 7, 3, 4


def _strand_hashes(k: int, pre: str) -> str:
    key = "list_reduce(list_transform(string_split({0}, ''), lambda c: instr('ACGT', c)::BIGINT - 1), lambda a, x: a * 4 + x, 0)"
    cut = f""", {pre}c AS (SELECT node_id AS id, i, substr(seq, i + 1, {k}) AS fwd, reverse(translate(substr(seq, i + 1, {k}), 'ACGT', 'TGCA')) AS rev
        FROM (SELECT *, unnest(range(0, len - {k} + 1)) AS i FROM nodes WHERE len >= {k})),
        {pre}k AS (SELECT *, {key.format("fwd")} AS kf, {key.format("rev")} AS kr FROM {pre}c)"""
    return cut + _wang("kf", f"{pre}k", f"{pre}f") + f", {pre}m AS (SELECT * RENAME (h AS hf) FROM {pre}f)" + _wang("kr", f"{pre}m", f"{pre}g") + (
        f", {pre} AS (SELECT *, least(hf, h) AS least_h, h < hf AS is_rev FROM {pre}g)"
    )


_OUT = "CASE WHEN is_rev THEN rev ELSE fwd END AS kmer, is_rev, (CASE WHEN is_rev THEN i + {0} - 1 ELSE i END)::INTEGER AS \"offset\"".format(K)
_WINS = f""", wins AS (SELECT id, i AS win, min(least_h) OVER w AS best, count(*) OVER w AS n FROM q
    WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {MW - 1} FOLLOWING)),
    won AS (SELECT q.*, win FROM q JOIN wins ON q.id = wins.id AND q.i BETWEEN win AND win + {MW - 1} AND least_h = best AND n = {MW})"""
_MIN = _strand_hashes(K, "q") + _WINS


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).nodes.select(F.col("node_id").alias("id"), "seq")


@query(sql(_MIN + f" SELECT DISTINCT id, {_OUT} FROM won"))
def minimizers(spark, sf):
    return kmers.minimizers(_labels(spark, sf), K, MW)


@query(sql(_MIN + f' SELECT id, {_OUT}, min(win)::INTEGER AS start, (max(win) - min(win) + {K} + {MW} - 1)::INTEGER AS length FROM won GROUP BY ALL'))
def minimizer_regions(spark, sf):
    return kmers.minimizer_regions(_labels(spark, sf), K, MW)


@query(sql(_strand_hashes(K, "q") + _strand_hashes(S_, "z") + f""", s AS (SELECT id, i, least_h, min(least_h) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {K - S_} FOLLOWING) AS best,
    lead(least_h, {K - S_}) OVER (PARTITION BY id ORDER BY i) AS last FROM z)
    SELECT q.id, {_OUT.replace('i +', 'q.i +').replace('ELSE i ', 'ELSE q.i ').replace('is_rev', 'q.is_rev', 1).replace(', is_rev', ', q.is_rev').replace('(CASE WHEN is_rev', '(CASE WHEN q.is_rev')}
    FROM q JOIN s ON q.id = s.id AND q.i = s.i WHERE s.least_h = best OR last = best"""))
def syncmers(spark, sf):
    return kmers.syncmers(_labels(spark, sf), K, S_)


def _downweighted(h: str) -> str:
    """dna.downweight in three rounds."""
    m = "18446744073709551615::HUGEINT"
    rest = f"({m} - {h})"
    for _ in range(3):
        rest = f"(({rest} // 4294967296) * ({rest} // 4294967296))"
    return f"({m} - {rest})"


#: k-mers with over 20 hits are listed, on both strands.
_WEIGHTED = _strand_hashes(K, "v") + f""", often AS (SELECT least(fwd, rev) AS kmer FROM vc GROUP BY ALL HAVING count(*) > 20),
    listed AS (SELECT kmer FROM often UNION SELECT reverse(translate(kmer, 'ACGT', 'TGCA')) FROM often),
    weighted AS (SELECT id, i, fwd, rev, CASE WHEN l.kmer IS NULL THEN hf ELSE {_downweighted("hf")} END AS f, CASE WHEN l.kmer IS NULL THEN h ELSE {_downweighted("h")} END AS g FROM vg LEFT JOIN listed l ON l.kmer = fwd),
    q AS (SELECT *, least(f, g) AS least_h, g < f AS is_rev FROM weighted)""" + _WINS


@query(sql(_WEIGHTED + f" SELECT DISTINCT id, {_OUT} FROM won"))
def weighted_minimizers(spark, sf):
    labels = _labels(spark, sf)
    often = kmers.frequent_keys(kmers.frequent_kmers(kmers.canonical_kmers(labels, K), 20))
    return kmers.minimizers(labels, K, MW, frequent=often, rounds=3)


def _placed(k: int, hits: str) -> str:
    """Hits (walk, fwd, rev, i, is_rev) on windows w as positions on nodes, with the walk that each covers."""
    return f""", hits AS ({hits}), located AS (SELECT walk, CASE WHEN is_rev THEN rev ELSE fwd END AS kmer, is_rev, i, CASE WHEN is_rev THEN i + {k - 1} ELSE i END AS o FROM hits),
        mine AS (SELECT a.walk, a.i, a.kmer, p.node_id, a.is_rev <> p.is_rev AS is_rev, (CASE WHEN a.is_rev THEN p.len - 1 - (a.o - p.start) ELSE a.o - p.start END)::INTEGER AS "offset"
            FROM located a JOIN parts p ON p.walk = a.walk AND p.start <= a.o AND a.o < p.start + p.len)"""


def _on_windows(w: int) -> str:
    """CTEs of the k-mers of window sequences: {pre}c and hashes as in _strand_hashes, with the walk as id."""
    return _all_windows(w) + ", w AS (SELECT walk FROM win)" + _SPELT + ", labelled AS (SELECT walk AS node_id, seq, length(seq) AS len FROM read)"


def _window_minimizers(w: int) -> str:
    inner = _strand_hashes(K, "q").replace("FROM nodes WHERE", "FROM labelled WHERE") + _WINS
    return _on_windows(w) + inner + _placed(K, "SELECT DISTINCT id AS walk, fwd, rev, i, is_rev FROM won")


@query(sql(_window_minimizers(K + MW - 1) + ' SELECT DISTINCT kmer, node_id, is_rev, "offset" FROM mine'))
def minimizer_index(spark, sf):
    return kmers.minimizer_index(graph(spark, sf), K, MW)


@query(sql(_window_minimizers(K + MW - 1) + f""", covered AS (SELECT m.kmer, m.node_id, m.is_rev, m."offset", string_agg((CASE WHEN p.is_rev THEN '<' ELSE '>' END) || p.node_id, '' ORDER BY p.i) AS cover, count(*) AS n
        FROM mine m JOIN parts p ON p.walk = m.walk AND p.start + p.len > m.i AND p.start < m.i + {K} GROUP BY m.walk, m.i, m.kmer, m.node_id, m.is_rev, m."offset"),
    wanted AS (SELECT DISTINCT cover, n FROM covered),
    sides AS (SELECT path_id, (CASE WHEN is_rev THEN '<' ELSE '>' END) || node_id AS t, list((CASE WHEN is_rev THEN '<' ELSE '>' END) || node_id) OVER (PARTITION BY path_id, ori ORDER BY step ROWS BETWEEN CURRENT ROW AND {K} FOLLOWING) AS ts FROM steps_bi),
    ranked AS (SELECT path_id, CASE WHEN n_all <= 64 THEN r_all WHEN n_two <= 64 THEN r_two WHEN n_one <= 64 THEN r_one ELSE 0 END AS hap FROM (
        SELECT path_id, dense_rank() OVER (ORDER BY sample NULLS FIRST, haplotype NULLS FIRST, contig NULLS FIRST) - 1 AS r_all, dense_rank() OVER (ORDER BY sample NULLS FIRST, haplotype NULLS FIRST) - 1 AS r_two,
            dense_rank() OVER (ORDER BY sample NULLS FIRST) - 1 AS r_one FROM paths), (SELECT count(DISTINCT (sample, haplotype, contig)) AS n_all, count(DISTINCT (sample, haplotype)) AS n_two, count(DISTINCT sample) AS n_one FROM paths)),
    bits AS (SELECT cover, bit_or(1::BIGINT << hap) AS hap_bits FROM (SELECT DISTINCT cover, path_id FROM wanted JOIN sides ON t = regexp_extract(cover, '^[<>][0-9]+') AND array_to_string(ts[1:n], '') = cover) JOIN ranked USING (path_id) GROUP BY cover)
    SELECT kmer, node_id, is_rev, "offset", bit_or(hap_bits) AS hap_bits FROM covered JOIN bits USING (cover) GROUP BY ALL"""))
def haplotype_bitmaps(spark, sf):
    return kmers.minimizer_index_with_paths(graph(spark, sf), K, MW)


_ALL_KMERS = f"""SELECT walk, fwd, rev, i, rev <= fwd AS is_rev FROM (SELECT walk, i, substr(seq, i + 1, {K}) AS fwd, reverse(translate(substr(seq, i + 1, {K}), 'ACGT', 'TGCA')) AS rev
    FROM (SELECT *, unnest(range(0, length(seq) - {K} + 1)) AS i FROM read WHERE length(seq) >= {K}))"""


@query(sql(_on_windows(K) + _placed(K, _ALL_KMERS) + ' SELECT DISTINCT kmer, node_id, is_rev, "offset" FROM mine'))
def kmer_index(spark, sf):
    return kmers.kmer_index(graph(spark, sf), K)


# Components.


def _kept(gr: g.HapGraph) -> g.HapGraph:
    """The graph with its steps written once, for queries that go over them several times."""
    return replace(gr, steps=settle(gr.steps))


_CC = """, cc(id, comp) USING KEY (id) AS (
    SELECT DISTINCT node_id, node_id FROM steps
    UNION (SELECT u.id, min(v.comp) FROM recurring.cc AS u JOIN edges_bi e ON e.from_id = u.id JOIN cc AS v ON e.to_id = v.id WHERE v.comp < u.comp GROUP BY u.id))"""


@query(sql(_CC + " SELECT id AS node_id, comp AS component_id FROM cc", recursive=True))
def components(spark, sf):
    return C.component_ids(graph(spark, sf))


@query(sql(_CC + " SELECT id AS node_id, comp AS component_id FROM cc", recursive=True, layered=True))
def components_of_layers(spark, sf):
    return C.component_ids(layers(spark, sf))


@query(sql(_CC + " SELECT comp AS component_id, count(*) AS n_nodes FROM cc GROUP BY comp", recursive=True, layered=True))
def component_sizes(spark, sf):
    return C.component_sizes(C.component_ids(layers(spark, sf)))


@query(sql(_CC + """, first_ref AS (SELECT c.comp, min(path_id) FILTER (sense = 'REFERENCE') AS r, min(path_id) FILTER (sense = 'GENERIC') AS q
    FROM steps s JOIN cc c ON c.id = s.node_id JOIN paths p USING (path_id) WHERE s.step = 0 GROUP BY c.comp),
    comps AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS i FROM (SELECT DISTINCT comp FROM cc))
    SELECT comps.comp AS component_id, coalesce((SELECT contig FROM paths WHERE path_id = coalesce(r, q)), 'component_' || i) AS contig
    FROM comps LEFT JOIN first_ref USING (comp)""", recursive=True, layered=True))
def contig_names(spark, sf):
    gr = _kept(layers(spark, sf))
    return C.contig_names(gr, C.component_ids(gr))


BOUND = 130
_JOBS = _CC + f""", sizes AS (SELECT comp, n, row_number() OVER (ORDER BY comp) AS i FROM (SELECT comp, count(*) AS n FROM cc GROUP BY comp)),
    jobs(i, comp, n, job, held) AS (SELECT i, comp, n, 0, n FROM sizes WHERE i = 1 UNION ALL
        SELECT s.i, s.comp, s.n, j.job + (j.held + s.n > {BOUND})::INTEGER, CASE WHEN j.held + s.n > {BOUND} THEN s.n ELSE j.held + s.n END FROM jobs j JOIN sizes s ON s.i = j.i + 1)"""


@query(sql(_JOBS + " SELECT comp AS component_id, job AS job_id, n AS n_nodes FROM jobs", recursive=True, layered=True))
def construction_jobs(spark, sf):
    return C.construction_jobs(C.component_ids(layers(spark, sf)), BOUND)


@query(sql(_JOBS + """ SELECT s.path_id, j.job AS job_id FROM steps s JOIN cc c ON c.id = s.node_id JOIN jobs j ON j.comp = c.comp JOIN paths p ON p.path_id = s.path_id
    WHERE s.step = 0 AND p.sense <> 'HAPLOTYPE'""", recursive=True, layered=True))
def path_jobs(spark, sf):
    gr = _kept(layers(spark, sf))
    ids = C.component_ids(gr)
    return C.assign_paths(gr, ids, C.construction_jobs(ids, BOUND))


@query(sql(_JOBS + """, told AS (SELECT s.path_id, j.job, CASE WHEN sense = 'HAPLOTYPE' THEN 1 ELSE 0 END AS k FROM steps s JOIN cc c ON c.id = s.node_id JOIN jobs j ON j.comp = c.comp JOIN paths p ON p.path_id = s.path_id WHERE s.step = 0)
    SELECT path_id, job AS job_id, row_number() OVER (ORDER BY job, k, path_id) - 1 AS new_id FROM told""", recursive=True, layered=True))
def job_ordered_paths(spark, sf):
    gr = _kept(layers(spark, sf))
    ids = C.component_ids(gr)
    return C.paths_by_job(gr, ids, C.construction_jobs(ids, BOUND)).select("path_id", "job_id", "new_id")


@query(sql(_CC + " SELECT s.path_id, c.comp AS component_id FROM steps s JOIN cc c ON c.id = s.node_id WHERE s.step = 0", recursive=True))
def chunks(spark, sf):
    gr = _kept(graph(spark, sf))
    return C.chunk_paths(gr, C.component_ids(gr))


@query(sql(_CC + """, at AS (SELECT s.path_id, c.comp FROM steps s JOIN cc c ON c.id = s.node_id WHERE s.step = 0)
    SELECT path_id, sample, contig FROM paths WHERE path_id IN (SELECT path_id FROM at WHERE comp IN (SELECT comp FROM at JOIN paths USING (path_id) WHERE contig = '1-URGENT'))""".replace(" at ", " spots ").replace(", at AS", ", spots AS"), recursive=True))
def contig_paths(spark, sf):
    gr = _kept(graph(spark, sf))
    return C.contig_paths(gr, C.component_ids(gr), "1-URGENT").select("path_id", "sample", "contig")


@query(sql("""SELECT (SELECT count(*) FROM paths) * 2 AS n_paths, (SELECT count(DISTINCT node_id) FROM steps) * 2 AS n_nodes, (SELECT count(*) FROM edges) * 2 AS n_edges"""))
def merge_graphs(spark, sf):
    a = graph(spark, sf)
    shift = a.nodes.agg(F.max("node_id")).first()[0] or 0
    moved = g.HapGraph(a.nodes.withColumn("node_id", F.col("node_id") + shift), a.paths, a.steps.withColumn("node_id", F.col("node_id") + shift))
    both = g.merge([a, moved])
    made = [both.paths.agg(F.count(F.lit(1)).alias("n_paths")), both.visited.agg(F.count(F.lit(1)).alias("n_nodes")), both.edges.agg(F.count(F.lit(1)).alias("n_edges"))]
    one = [x.withColumn("k", F.lit(1)) for x in made]
    return one[0].join(one[1], "k").join(one[2], "k").drop("k")


@query(sql(""", rs AS (SELECT s.* FROM steps s JOIN paths p USING (path_id) WHERE p.sense = 'REFERENCE'),
    rp AS (SELECT node_id AS a, is_rev AS ar, lead(node_id) OVER w AS b, lead(is_rev) OVER w AS br FROM rs WINDOW w AS (PARTITION BY path_id ORDER BY step)),
    rb AS (SELECT a AS from_id, ar AS from_rev, b AS to_id, br AS to_rev FROM rp WHERE b IS NOT NULL UNION SELECT b, NOT br, a, NOT ar FROM rp WHERE b IS NOT NULL)
    SELECT * FROM rb WHERE CASE WHEN NOT from_rev THEN to_id >= from_id ELSE to_id > from_id OR (to_id = from_id AND NOT to_rev) END"""))
def restricted_edges(spark, sf):
    return g.restrict(graph(spark, sf), F.col("sense") == "REFERENCE").edges


@query(sql(_CC + " SELECT path_id AS chain_id, arg_min(comp, node_id) AS component_id FROM steps JOIN cc ON id = node_id WHERE path_id % 3 = 0 GROUP BY path_id", recursive=True, layered=True))
def partition_chains(spark, sf):
    gr = _kept(layers(spark, sf))
    return C.partition_chains(C.component_ids(gr), gr.steps.where("path_id % 3 = 0").select(F.col("path_id").alias("chain_id"), "node_id"))


#: above: which handles are after which; nice: components that their heads reach in one orientation each, without a cycle.
_HEADS = _CC + """, above(a, ar, b, br) AS (SELECT * FROM edges_bi UNION SELECT x.a, x.ar, e.to_id, e.to_rev FROM above x JOIN edges_bi e ON e.from_id = x.b AND e.from_rev = x.br),
    heads AS (SELECT id, comp FROM cc WHERE NOT EXISTS (SELECT 1 FROM edges_bi WHERE to_id = id AND NOT to_rev)),
    reached AS (SELECT id, false AS r, comp FROM heads UNION SELECT b, br, comp FROM heads JOIN above ON a = id AND NOT ar),
    loops AS (SELECT DISTINCT comp FROM above JOIN cc ON id = a WHERE a = b AND ar = br),
    outside AS (SELECT DISTINCT comp FROM reached JOIN edges_bi ON to_id = id AND to_rev = r WHERE NOT EXISTS (SELECT 1 FROM reached y WHERE y.id = from_id AND y.r = from_rev)),
    nice AS (SELECT comp FROM (SELECT comp, count(*) AS n FROM reached GROUP BY comp) JOIN (SELECT comp, count(*) AS m FROM cc GROUP BY comp) USING (comp)
        WHERE n = m AND comp NOT IN (SELECT comp FROM outside) AND comp NOT IN (SELECT comp FROM reached x JOIN above ON a = id AND ar = r AND b = id AND br = r))"""


@query(sql(_HEADS + " SELECT comp AS component_id, id AS node_id FROM heads WHERE comp IN (SELECT comp FROM nice)", recursive=True, layered=True))
def head_nodes(spark, sf):
    gr = _kept(layers(spark, sf))
    return C.head_nodes(gr, C.component_ids(gr))


@query(sql(_HEADS + """, depth(id, r, d) USING KEY (id, r) AS (
        SELECT id, x.r, 0::BIGINT FROM cc, (VALUES (false), (true)) x(r) WHERE comp NOT IN (SELECT comp FROM loops)
        UNION (SELECT e.to_id, e.to_rev, max(l.d) + 1 FROM depth l JOIN edges_bi e ON e.from_id = l.id AND e.from_rev = l.r JOIN recurring.depth o ON o.id = e.to_id AND o.r = e.to_rev WHERE l.d + 1 > o.d GROUP BY ALL))
    SELECT comp AS component_id, row_number() OVER (PARTITION BY comp ORDER BY d, id, r) - 1 AS position, id AS node_id, r AS is_rev FROM depth JOIN cc USING (id)""", recursive=True, layered=True))
def topological_order(spark, sf):
    gr = _kept(layers(spark, sf))
    return C.topological_order(gr, C.component_ids(gr))


# Positions, runs, alignments.


@query(sql("""SELECT p.path_id, (p.o_offset)::BIGINT AS "offset", s.step, s.node_id, s.is_rev, (p.o_offset - s.bp_offset)::BIGINT AS inside
    FROM (SELECT path_id, sum(len) // 2 AS o_offset FROM placed GROUP BY path_id) p JOIN placed s ON s.path_id = p.path_id AND s.bp_offset <= p.o_offset AND p.o_offset < s.bp_offset + s.len"""))
def position_lookup(spark, sf):
    gr = graph(spark, sf)
    middle = paths.path_lengths(gr).select("path_id", F.expr("bp div 2").alias("offset"))
    return U.positions(paths.offsets(gr), middle)


@query(sql(""", inside AS (SELECT s.*, s.step - row_number() OVER (PARTITION BY path_id ORDER BY step) AS island FROM steps s
    WHERE node_id IN (SELECT node_id FROM steps JOIN paths USING (path_id) WHERE sense = 'REFERENCE'))
    SELECT path_id, min(step) AS first_step, string_agg((CASE WHEN is_rev THEN '<' ELSE '>' END) || node_id, '' ORDER BY step) AS walk FROM inside GROUP BY path_id, island"""))
def subgraph_paths(spark, sf):
    gr = graph(spark, sf)
    ids = paths.steps_on(gr, sense="REFERENCE").select("node_id").distinct()
    return U.runs(gr, ids).select("path_id", "first_step", windows.walk_text(F.col("nodes")).alias("walk"))


_WALKS_OF_RUNS = """, inside AS (SELECT s.*, s.step - row_number() OVER (PARTITION BY path_id ORDER BY step) AS island FROM steps s WHERE node_id IN (SELECT node_id FROM ids)),
    ways AS (SELECT path_id, island, 0 AS ori, step AS k, node_id, is_rev FROM inside UNION ALL SELECT path_id, island, 1, -step, node_id, NOT is_rev FROM inside),
    found AS (SELECT string_agg((CASE WHEN is_rev THEN '<' ELSE '>' END) || node_id, '' ORDER BY k) AS walk, arg_min(node_id, k) AS a, arg_min(is_rev, k) AS ar, arg_max(node_id, k) AS b, arg_max(is_rev, k) AS br FROM ways GROUP BY path_id, island, ori)
    SELECT walk, count(*) AS weight FROM found WHERE (NOT ar AND NOT br) OR (ar <> br AND CASE WHEN NOT ar THEN b >= a ELSE b > a OR (b = a AND NOT br) END) GROUP BY walk"""


@query(sql(", ids AS (SELECT node_id FROM steps JOIN paths USING (path_id) WHERE sense = 'REFERENCE')" + _WALKS_OF_RUNS))
def distinct_haplotypes(spark, sf):
    gr = graph(spark, sf)
    ids = paths.steps_on(gr, sense="REFERENCE").select("node_id").distinct()
    runs = U.canonical_runs(U.runs(gr, ids))
    return U.weights(runs).select(windows.walk_text(F.col("nodes")).alias("walk"), "weight")


def _busiest(spark: SparkSession, sf: str) -> tuple[g.HapGraph, dict, int]:
    """The longest path (the smallest id of these) and its middle."""
    gr = graph(spark, sf)
    top = paths.path_lengths(gr).join(gr.paths, "path_id").orderBy(F.desc("bp"), "path_id").limit(1).collect()[0]
    return gr, top.asDict(), top["fragment"] + top["bp"] // 2


CONTEXT = 8


def _within(context: int) -> str:
    """ids of the nodes within a context of the middle of the longest path. A node counts at the least distance at which it is met, as it is met
    there (entry e<d> of a distance d; of two orientations the forward one); p<d> is where each leads from there."""
    leave = "CASE WHEN side.r = x.r THEN n.len - x.off ELSE x.off + 1 END"
    parts = [""", top AS (SELECT path_id, bp FROM (SELECT path_id, sum(len) AS bp FROM placed GROUP BY path_id) ORDER BY bp DESC, path_id LIMIT 1),
        e0 AS MATERIALIZED (SELECT node_id AS id, is_rev AS r, top.bp // 2 - bp_offset AS off FROM placed JOIN top USING (path_id) WHERE bp_offset <= top.bp // 2 AND top.bp // 2 < bp_offset + len)"""]
    for d in range(context + 1):
        if d:
            met = " UNION ALL ".join(f"SELECT id, r FROM p{k} WHERE d = {d}" for k in range(d))
            known = " UNION ALL ".join(f"SELECT id FROM e{k}" for k in range(d))
            parts.append(f"e{d} AS MATERIALIZED (SELECT id, bool_and(r) AS r, 0 AS off FROM ({met}) WHERE id NOT IN ({known}) GROUP BY id)")
        parts.append(f"""p{d} AS MATERIALIZED (SELECT DISTINCT e.to_id AS id, e.to_rev AS r, {d} + {leave} AS d FROM e{d} x JOIN nodes n ON n.node_id = x.id, (VALUES (false), (true)) side(r)
            JOIN edges_bi e ON e.from_id = x.id AND e.from_rev = side.r WHERE {d} + {leave} <= {context})""")
    return ", ".join(parts) + ", ids AS (" + " UNION ALL ".join(f"SELECT id AS node_id FROM e{d}" for d in range(context + 1)) + ")"


def _busiest(spark: SparkSession, sf: str) -> tuple[g.HapGraph, dict, int]:
    """The longest path (the smallest id of these) and its middle."""
    gr = graph(spark, sf)
    top = paths.path_lengths(gr).join(gr.paths, "path_id").orderBy(F.desc("bp"), "path_id").limit(1).collect()[0]
    return gr, top.asDict(), top["fragment"] + top["bp"] // 2


@query(sql(_within(CONTEXT) + " SELECT node_id, seq FROM nodes WHERE node_id IN (SELECT node_id FROM ids)"))
def subgraph_nodes(spark, sf):
    gr, p, at = _busiest(spark, sf)
    found = U.around_offset(gr, p["sample"], p["contig"], p["haplotype"], at, CONTEXT)
    return gr.nodes.join(found.ids, "node_id", "left_semi").select("node_id", "seq")


@query(sql(_within(CONTEXT) + _WALKS_OF_RUNS))
def subgraph_haplotypes(spark, sf):
    gr, p, at = _busiest(spark, sf)
    found = U.around_offset(gr, p["sample"], p["contig"], p["haplotype"], at, CONTEXT)
    return U.weights(U.canonical_runs(U.runs(gr, found.ids))).select(windows.walk_text(F.col("nodes")).alias("walk"), "weight")


@query()
def subgraph_gfa(spark, sf):
    gr, p, at = _busiest(spark, sf)
    return U.gfa_lines(gr, U.around_offset(gr, p["sample"], p["contig"], p["haplotype"], at, CONTEXT), U.DISTINCT)


def _path_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each path with the one of the next id, as arrays of (node_id, is_rev, oriented label)."""
    gr = graph(spark, sf)
    read = gr.steps.join(gr.nodes, "node_id").withColumn("oseq", dna.oriented("seq", "is_rev"))
    rows = read.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node_id", "is_rev", "oseq"))), lambda x: F.struct(x["node_id"].alias("n"), x["is_rev"].alias("r"), x["oseq"].alias("s"))).alias("walk"))
    nxt = rows.select((F.col("path_id") - 1).alias("path_id"), F.col("walk").alias("other"))
    return rows.join(nxt, "path_id")


def _walk(x) -> tuple[list, dict]:
    return [(d["n"], d["r"]) for d in x], {(d["n"], d["r"]): d["s"] for d in x}


@F.pandas_udf(StringType())
def _lcs_text(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        (p, label), (q, _) = _walk(x), _walk(y)
        out.append(",".join(f"{i}-{j}" for i, j in path_lcs(p, q, lambda h, label=label: len(label[h]))))
    return pd.Series(out)


@F.pandas_udf(StringType())
def _cigar_text(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        (p, one), (q, two) = _walk(x), _walk(y)
        out.append(to_cigar(align(p, q, {**one, **two}.__getitem__)))
    return pd.Series(out)


@query()
def path_lcs_pairs(spark, sf):
    return _path_pairs(spark, sf).select("path_id", _lcs_text("walk", "other").alias("pairs"))


@query()
def cigars(spark, sf):
    return _path_pairs(spark, sf).select("path_id", _cigar_text("walk", "other").alias("cigar"))


# Covers.


@query()
def path_cover(spark, sf):
    gr = _kept(layers(spark, sf))
    return cover.path_cover(gr, C.component_ids(gr), n=4, k=3)


@query()
def local_haplotypes(spark, sf):
    gr = _kept(layers(spark, sf))
    return cover.local_haplotypes(gr, C.component_ids(gr), n=4, k=3)


@query()
def augment(spark, sf):
    gr = _kept(layers(spark, sf))
    return cover.augment(gr, C.component_ids(gr), n=4, k=3, with_paths=gr.paths.where("sense <> 'HAPLOTYPE'"))


@query(sql(_CC + """, comps AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS k FROM (SELECT DISTINCT comp FROM cc)), last AS (SELECT max(path_id) AS m FROM paths)
    SELECT path_id, sense FROM paths WHERE sense <> 'HAPLOTYPE' UNION ALL SELECT m + 1 + 4 * k + i, 'HAPLOTYPE' FROM comps, last, range(4) r(i)""", recursive=True, layered=True))
def named_paths_and_cover(spark, sf):
    gr = _kept(layers(spark, sf))
    ids = C.component_ids(gr)
    return cover.named_and_cover(gr, ids, cover.path_cover(gr, ids, n=4, k=3)).paths.select("path_id", "sense")


# Names and text.

_LINES = """, lines AS (SELECT node_id, 0 AS side, 0 AS k, concat_ws(chr(9), 'S', node_id, seq) AS line FROM nodes WHERE node_id IN (SELECT node_id FROM steps)
    UNION ALL SELECT from_id, 1 + from_rev::INTEGER, 2 * to_id + to_rev::INTEGER, concat_ws(chr(9), 'L', from_id, CASE WHEN from_rev THEN '-' ELSE '+' END, to_id, CASE WHEN to_rev THEN '-' ELSE '+' END) FROM edges)"""


@query(sql(_LINES + " SELECT line FROM lines"))
def canonical_gfa(spark, sf):
    return lineage.canonical_gfa(graph(spark, sf))


@query(sql(_LINES + " SELECT sha256(string_agg(line || chr(10), '' ORDER BY node_id, side, k)) AS name FROM lines"))
def graph_name(spark, sf):
    return spark.createDataFrame([(lineage.compute_name(graph(spark, sf)),)], "name string")


#: Nations of a region are subgraphs of it; each nation translates to the next one of its region.
_RELATIONS = """rel AS (SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION SELECT n_name, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) FROM nation),
    arcs AS (SELECT * FROM rel WHERE dst IS NOT NULL AND src <> dst)"""


@query(f"""WITH RECURSIVE {_RELATIONS}, reach(src, dst, hops) AS (SELECT src, dst, 1 FROM arcs UNION
    SELECT r.src, a.dst, r.hops + 1 FROM reach r JOIN arcs a ON a.src = r.dst WHERE r.hops < (SELECT count(*) FROM arcs))
    SELECT src, dst, min(hops)::INTEGER AS hops FROM reach GROUP BY ALL""")
def lineage_paths(spark, sf):
    nation, region = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "region"))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("subgraph").alias("kind"), F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    side = nation.select(F.lit("translation").alias("kind"), F.col("n_name").alias("src"), F.lead("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("dst"))
    return lineage.reachable(up.unionByName(side.where("dst is not null")))


_WALKS = """, w AS (SELECT path_id, string_agg(node_id || CASE WHEN is_rev THEN '-' ELSE '+' END, ',' ORDER BY step) AS p,
    string_agg((CASE WHEN is_rev THEN '<' ELSE '>' END) || node_id, '' ORDER BY step) AS w, sum(len)::BIGINT AS bp FROM placed GROUP BY path_id)"""


@query(sql(_WALKS + " SELECT path_id, p AS p_walk, w AS w_walk, bp FROM w"))
def walk_strings(spark, sf):
    return gfa_out.walks(graph(spark, sf))


@query(sql(_LINES + _WALKS + """ SELECT 'H' || chr(9) || 'VN:Z:1.1' AS line UNION ALL SELECT line FROM lines WHERE side = 0
    UNION ALL SELECT line || chr(9) || '0M' FROM lines WHERE side > 0
    UNION ALL SELECT CASE sense WHEN 'GENERIC' THEN concat_ws(chr(9), 'P', contig || CASE WHEN fragment <> 0 THEN '[' || fragment || ']' ELSE '' END, p, '*')
    ELSE concat_ws(chr(9), 'W', sample, coalesce(haplotype, 0), contig, fragment, fragment + bp, w) END FROM paths JOIN w USING (path_id)"""))
def gfa_lines(spark, sf):
    return gfa_out.gfa_lines(graph(spark, sf)).select("line")


@query(sql(_WALKS + """ SELECT concat_ws(chr(9), 'P', concat_ws('#', sample, coalesce(haplotype::VARCHAR, '18446744073709551615'), contig)
    || CASE WHEN fragment <> 0 THEN '[' || fragment || ']' ELSE '' END, p, '*') AS line FROM paths JOIN w USING (path_id)"""))
def gfa_pan_sn_paths(spark, sf):
    return gfa_out.path_text(graph(spark, sf), "pan-sn").select("line")


_NAMED = """ SELECT CASE sense WHEN 'GENERIC' THEN concat_ws(chr(9), 'P', contig || CASE WHEN fragment <> 0 THEN '[' || fragment || ']' ELSE '' END, p, '*')
    ELSE concat_ws(chr(9), 'W', sample, coalesce(haplotype::VARCHAR, '18446744073709551615'), contig, fragment, fragment + bp, w) END AS line FROM paths JOIN w USING (path_id)"""


@query(sql(_WALKS + _NAMED + " WHERE sense <> 'HAPLOTYPE'"))
def gfa_reference_walks(spark, sf):
    return gfa_out.path_text(graph(spark, sf), "ref-only").select("line")


@query(sql(_WALKS + _NAMED, layered=True))
def gfa_walks_without_haplotype(spark, sf):
    return gfa_out.path_text(layers(spark, sf)).select("line")


@query(sql(_WALKS + " SELECT path_id, concat_ws(chr(9), 'P', path_id, p, '*') AS line FROM w"))
def gfa_all_paths(spark, sf):
    return gfa_out.all_paths(graph(spark, sf))


_CHOP = """, p AS (SELECT node_id, seq, ceil(len / 8.0)::BIGINT AS n, coalesce(sum(ceil(len / 8.0)::BIGINT) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM nodes)"""


@query(sql(_CHOP + " SELECT before + 1 + i AS node_id, substr(seq, i * 8 + 1, 8) AS seq, length(substr(seq, i * 8 + 1, 8)) AS len FROM (SELECT *, unnest(range(n)) AS i FROM p)"))
def chopped_segments(spark, sf):
    s = graph(spark, sf).nodes.select(F.col("node_id").alias("ord"), F.col("node_id").cast("string").alias("name"), "seq")
    return gfa.make_nodes(s, 8)[0]


@query(sql(_CHOP + " SELECT concat_ws(chr(9), 'T', 's' || node_id, array_to_string(range(before + 1, before + 1 + n), ',')) AS line FROM p"))
def translation_table(spark, sf):
    gr = graph(spark, sf)
    s = gr.nodes.select(F.col("node_id").alias("ord"), F.concat(F.lit("s"), "node_id").alias("name"), "seq")
    nodes, ranges, _ = gfa.make_nodes(s, 8)
    return gfa_out.translation_table(g.HapGraph(nodes, gr.paths, gr.steps, ranges)).select("line")
