"""Queries on the graph, its paths, searches, sequences and k-mers, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.functions import dna
from plait.operators import graph as g
from plait.operators import kmers, paths, search, segments
from plait.plans.driver_view import graph, sql, tables
from plait.sources import gfa, gfa_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query(sql("SELECT * FROM edges"))
def edges_canonical(spark, sf):
    return graph(spark, sf).edges


@query(sql("""SELECT h.node_id, h.is_rev, (SELECT count(*) FROM edges_bi e WHERE e.from_id = h.node_id AND e.from_rev = h.is_rev) AS right_degree,
    (SELECT count(*) FROM edges_bi e WHERE e.from_id = h.node_id AND e.from_rev = (NOT h.is_rev)) AS left_degree
    FROM handles h WHERE h.node_id IN (SELECT node_id FROM steps)"""))
def node_degrees(spark, sf):
    return g.degrees(graph(spark, sf))


@query(sql(""", d AS (SELECT from_id, from_rev, count(*) AS degree FROM edges_bi GROUP BY ALL)
    SELECT degree, count(*) AS n_handles FROM d GROUP BY degree"""))
def degree_histogram(spark, sf):
    d = g.degrees(graph(spark, sf)).where("right_degree > 0")
    return d.groupBy(F.col("right_degree").alias("degree")).agg(F.count(F.lit(1)).alias("n_handles"))


@query(sql("SELECT node_id, count(*) AS n_visits FROM steps GROUP BY node_id"))
def node_visits(spark, sf):
    return paths.node_visits(graph(spark, sf))


@query(sql(", v AS (SELECT node_id, count(*) AS n_visits FROM steps GROUP BY node_id) SELECT n_visits, count(*) AS n_nodes FROM v GROUP BY n_visits"))
def visit_histogram(spark, sf):
    return paths.node_visits(graph(spark, sf)).groupBy("n_visits").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(sql(""", asked AS (SELECT DISTINCT a AS from_id, ar AS from_rev, b AS to_id, (a % 2 = 0) AS to_rev FROM pairs WHERE b IS NOT NULL)
    SELECT asked.*, EXISTS (SELECT 1 FROM edges_bi e WHERE e.from_id = asked.from_id AND e.from_rev = asked.from_rev
    AND e.to_id = asked.to_id AND e.to_rev = asked.to_rev) AS found FROM asked"""))
def has_edge(spark, sf):
    gr = graph(spark, sf)
    after = paths.neighbours(gr.steps).where("has_next")
    asked = after.select(F.col("node_id").alias("from_id"), F.col("is_rev").alias("from_rev"), F.col("next_id").alias("to_id"), (F.col("node_id") % 2 == 0).alias("to_rev"))
    return g.has_edge(asked.distinct(), gr.edges_bi)


@query(sql("SELECT e.to_id AS node_id, e.to_rev AS is_rev, e.from_id AS next_id, e.from_rev AS next_rev FROM edges_bi e"))
def follow_edges_left(spark, sf):
    gr = graph(spark, sf)
    return g.follow_edges(g.handles(gr.nodes).select("node_id", "is_rev"), gr.edges_bi, left=True)


@query(sql("SELECT count(*) AS n_nodes, min(node_id) AS min_id, max(node_id) AS max_id FROM nodes WHERE node_id IN (SELECT node_id FROM steps)"))
def node_range(spark, sf):
    return g.node_range(graph(spark, sf))


@query(sql("SELECT path_id, count(*) AS n_steps, sum(len)::BIGINT AS bp FROM placed GROUP BY path_id"))
def path_lengths(spark, sf):
    return paths.path_lengths(graph(spark, sf))


@query(sql("SELECT path_id, step, node_id, is_rev, bp_offset::BIGINT AS bp_offset FROM placed"))
def step_offsets(spark, sf):
    return paths.offsets(graph(spark, sf)).select("path_id", "step", "node_id", "is_rev", "bp_offset")


@query(sql("""SELECT (SELECT count(DISTINCT node_id) FROM steps) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges,
    (SELECT sum(len)::BIGINT FROM nodes WHERE node_id IN (SELECT node_id FROM steps)) AS node_bp, (SELECT count(*) FROM paths) AS n_paths,
    (SELECT count(*) FROM steps) AS n_steps, (SELECT sum(len)::BIGINT FROM placed) AS path_bp"""))
def graph_stats(spark, sf):
    gr = graph(spark, sf)
    nodes = gr.visited.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("len").alias("node_bp"))
    edges, n_paths = gr.edges.agg(F.count(F.lit(1)).alias("n_edges")), gr.paths.agg(F.count(F.lit(1)).alias("n_paths"))
    steps = paths.with_lengths(gr).agg(F.count(F.lit(1)).alias("n_steps"), F.sum("len").alias("path_bp"))
    # Four single rows, put beside each other by one key.
    one = [x.withColumn("k", F.lit(1)) for x in (nodes, edges, n_paths, steps)]
    return one[0].join(one[1], "k").join(one[2], "k").join(one[3], "k").drop("k")


@query(sql("SELECT node_id, is_rev, oseq, substr(oseq, 3, 4) AS sub, substr(oseq, 1, 1) AS first_base, ends_with(oseq, 'A') AS ends_a, starts_with(oseq, 'C') AS starts_c, len FROM handles"))
def oriented_sequences(spark, sf):
    h = g.handles(graph(spark, sf).nodes)
    s = F.col("oseq")
    return h.select("node_id", "is_rev", "oseq", dna.subsequence(s, 2, 4).alias("sub"), dna.base_at(s, 0).alias("first_base"), dna.ends_with(s, "A").alias("ends_a"), dna.starts_with(s, "C").alias("starts_c"), "len")


@query(sql("SELECT node_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM nodes"))
def reverse_complement(spark, sf):
    return graph(spark, sf).nodes.select("node_id", dna.reverse_complement("seq").alias("rc"))


@query(sql("""SELECT path_id, CASE sense WHEN 'GENERIC' THEN contig WHEN 'REFERENCE' THEN concat_ws('#', sample, haplotype, contig)
    ELSE concat_ws('#', sample, coalesce(haplotype, 0), contig, fragment) END AS name FROM paths"""))
def path_names(spark, sf):
    return paths.described(graph(spark, sf).paths).select("path_id", "name")


@query(sql("""SELECT path_id, sense, CASE WHEN sense = 'HAPLOTYPE' THEN fragment END AS phase_block,
    CASE WHEN sense <> 'HAPLOTYPE' AND fragment <> 0 THEN fragment END AS subrange_start, false AS is_circular FROM paths"""))
def path_senses(spark, sf):
    return paths.described(graph(spark, sf).paths).select("path_id", "sense", "phase_block", "subrange_start", "is_circular")


@query(sql("SELECT path_id, sample, contig FROM paths WHERE sense IN ('REFERENCE', 'HAPLOTYPE') AND contig IN ('1-URGENT', '2-HIGH') AND sample IN ('c1', 'c2', 'c50', 'c100')"))
def paths_matching(spark, sf):
    found = paths.matching(graph(spark, sf).paths, {"REFERENCE", "HAPLOTYPE"}, {"c1", "c2", "c50", "c100"}, {"1-URGENT", "2-HIGH"})
    return found.select("path_id", "sample", "contig")


@query(sql("SELECT s.path_id, s.step, s.node_id, s.is_rev, p.sample FROM steps s JOIN paths p USING (path_id) WHERE p.sense = 'REFERENCE'"))
def steps_of_sense(spark, sf):
    gr = graph(spark, sf)
    return paths.steps_on(gr, gr.nodes, "REFERENCE").select("path_id", "step", "node_id", "is_rev", "sample")


@query(sql("""SELECT p.path_id, CASE sense WHEN 'GENERIC' THEN contig ELSE concat_ws('#', sample, haplotype, contig) END AS name,
    arg_min(s.node_id, s.step) AS first_id, arg_max(s.node_id, s.step) AS last_id, count(s.step) AS n_steps
    FROM paths p LEFT JOIN steps s USING (path_id) WHERE sense <> 'HAPLOTYPE' GROUP BY ALL"""))
def named_paths(spark, sf):
    return paths.named_paths(graph(spark, sf)).select("path_id", "name", "first_id", "last_id", "n_steps")


@query(sql("""SELECT p.path_id, count(s.step) AS n_steps FROM paths p LEFT JOIN steps s USING (path_id) GROUP BY p.path_id"""))
def step_counts(spark, sf):
    return paths.step_counts(graph(spark, sf)).select("path_id", "n_steps")


@query(sql("SELECT path_id, (dense_rank() OVER (ORDER BY sense, haplotype NULLS FIRST, sense) - 1)::INTEGER AS hap_id FROM paths"))
def haplotype_ids(spark, sf):
    senses = graph(spark, sf).paths.withColumn("sample", F.col("sense")).withColumn("contig", F.col("sense"))
    return paths.haplotype_ids(senses).select("path_id", "hap_id")


@query(sql("SELECT path_id, 0 AS hap_id FROM paths"))
def haplotype_ids_overflow(spark, sf):
    return paths.haplotype_ids(graph(spark, sf).paths, most=2).select("path_id", "hap_id")


@query(sql("""SELECT path_id, row_number() OVER (PARTITION BY sample, contig, haplotype ORDER BY path_id) - 1 AS fragment FROM paths"""))
def fragment_counts(spark, sf):
    blank = graph(spark, sf).paths.withColumn("fragment", F.lit(None).cast("bigint"))
    return paths.add_fragments(blank, [F.col("path_id")]).select("path_id", "fragment")


@query(sql("""SELECT path_id, step, lag(node_id) OVER w AS prev_id, lag(is_rev) OVER w AS prev_rev, lead(node_id) OVER w AS next_id,
    lead(is_rev) OVER w AS next_rev FROM steps WINDOW w AS (PARTITION BY path_id ORDER BY step)"""))
def next_prev_steps(spark, sf):
    return paths.neighbours(graph(spark, sf).steps).select("path_id", "step", "prev_id", "prev_rev", "next_id", "next_rev")


#: The walk of the first edge of the graph, as both engines find it.
_FIRST = ", walk AS (SELECT from_id AS a, from_rev AS ar, to_id AS b, to_rev AS br FROM edges ORDER BY from_id, from_rev, to_id, to_rev LIMIT 1)"
_FOUND = _FIRST + """, next AS (SELECT *, lead(node_id) OVER w AS n, lead(is_rev) OVER w AS nr FROM steps_bi WINDOW w AS (PARTITION BY path_id, ori ORDER BY step)),
    found AS (SELECT path_id, ori, step + 1 AS step FROM next JOIN walk ON node_id = a AND is_rev = ar AND n = b AND nr = br)"""


def _walk(gr: g.HapGraph) -> search.Walk:
    e = gr.edges.orderBy("from_id", "from_rev", "to_id", "to_rev").limit(1).collect()
    return [(e[0].from_id, e[0].from_rev), (e[0].to_id, e[0].to_rev)] if e else []


@query(sql(_FOUND + " SELECT * FROM found"))
def find_subpath(spark, sf):
    gr = graph(spark, sf)
    return search.find(gr.steps_bi, _walk(gr))


@query(sql(_FOUND + """ SELECT n.node_id, n.is_rev, count(*) AS n_visits FROM found f JOIN steps_bi n
    ON n.path_id = f.path_id AND n.ori = f.ori AND n.step = f.step + 1 GROUP BY ALL"""))
def follow_paths_right(spark, sf):
    gr = graph(spark, sf)
    return search.follow_paths(search.find(gr.steps_bi, _walk(gr)), gr.steps_bi)


@query(sql(_FOUND + """ SELECT n.node_id, n.is_rev, count(*) AS n_visits FROM found f JOIN steps_bi n
    ON n.path_id = f.path_id AND n.ori = f.ori AND n.step = f.step - 2 GROUP BY ALL"""))
def follow_paths_left(spark, sf):
    gr = graph(spark, sf)
    return search.follow_paths(search.find(gr.steps_bi, _walk(gr)), gr.steps_bi, backward=True, length=2)


@query(sql(_FOUND + " SELECT DISTINCT path_id, ori FROM found"))
def locate(spark, sf):
    gr = graph(spark, sf)
    return search.locate(search.find(gr.steps_bi, _walk(gr)))


_SEQ = """SELECT path_id, {0} AS seq FROM (SELECT s.path_id, string_agg(h.oseq, '' ORDER BY s.step) AS seq FROM steps s
    JOIN handles h ON s.node_id = h.node_id AND s.is_rev = h.is_rev GROUP BY s.path_id)"""


@query(sql(_SEQ.format("seq")))
def path_sequences(spark, sf):
    return paths.sequences(graph(spark, sf))


@query(sql(_SEQ.format("reverse(translate(seq, 'ACGT', 'TGCA'))")))
def path_sequences_rc(spark, sf):
    return paths.sequences(graph(spark, sf), reverse=True)


_KMERS = """, spots AS (SELECT node_id AS id, seq, unnest(range(0, len - 5 + 1)) AS i FROM nodes WHERE len >= 5),
    k AS (SELECT id, i, substr(seq, i + 1, 5) AS fwd, reverse(translate(substr(seq, i + 1, 5), 'ACGT', 'TGCA')) AS rev FROM spots),
    hits AS (SELECT id, least(fwd, rev) AS kmer, rev <= fwd AS is_rev, (CASE WHEN rev <= fwd THEN i + 4 ELSE i END)::INTEGER AS "offset" FROM k)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.canonical_kmers(graph(spark, sf).nodes, 5, "node_id")


@query(sql(_KMERS + " SELECT * FROM hits"))
def canonical_kmers(spark, sf):
    return _hits(spark, sf)


@query(sql(_KMERS + ' SELECT kmer, count(*) AS n_hits, min(id) AS first_node FROM (SELECT DISTINCT kmer, id, is_rev, "offset" FROM hits) GROUP BY kmer'))
def kmer_hits(spark, sf):
    return _hits(spark, sf).distinct().groupBy("kmer").agg(F.count(F.lit(1)).alias("n_hits"), F.min("id").alias("first_node"))


@query(sql(_KMERS + " SELECT n_hits, count(*) AS n_kmers FROM (SELECT kmer, count(*) AS n_hits FROM hits GROUP BY kmer) GROUP BY n_hits"))
def kmer_histogram(spark, sf):
    return kmers.hit_histogram(_hits(spark, sf))


@query(sql(_KMERS + " SELECT kmer, count(*) AS n_hits FROM hits GROUP BY kmer HAVING count(*) > 20"))
def frequent_kmers(spark, sf):
    return kmers.frequent_kmers(_hits(spark, sf), 20)


@query(sql(_KMERS + " SELECT substr(kmer, 3, 1) AS middle, count(DISTINCT kmer) AS n_kmers, count(*) AS n_hits FROM hits GROUP BY ALL"))
def kmers_by_middle_base(spark, sf):
    parts = kmers.by_middle_base(_hits(spark, sf), 5)
    made = [d.groupBy(F.lit(b).alias("middle")).agg(F.countDistinct("kmer").alias("n_kmers"), F.count(F.lit(1)).alias("n_hits")) for b, d in parts.items()]
    return made[0].unionAll(made[1]).unionAll(made[2]).unionAll(made[3])


@query(sql(_KMERS + " SELECT h.* FROM hits h WHERE id IN (SELECT s.node_id FROM steps s JOIN paths p USING (path_id) WHERE p.sense = 'REFERENCE')"))
def hits_in_subgraph(spark, sf):
    gr = graph(spark, sf)
    index = kmers.canonical_kmers(gr.nodes, 5, "node_id").withColumnRenamed("id", "node_id")
    return kmers.hits_in_subgraph(index, paths.steps_on(gr, sense="REFERENCE").select("node_id").distinct()).withColumnRenamed("node_id", "id")


@query(sql(_KMERS + " SELECT count(*) AS n_keys, sum(n)::BIGINT AS n_values, count(*) FILTER (n = 1) AS n_unique FROM (SELECT kmer, count(*) AS n FROM hits GROUP BY kmer)"))
def index_statistics(spark, sf):
    return kmers.index_statistics(_hits(spark, sf))


@query(sql(_KMERS + """ SELECT kmer, key, kmer AS back FROM (SELECT DISTINCT kmer, list_reduce(list_transform(string_split(kmer, ''),
    lambda c: instr('ACGT', c)::BIGINT - 1), lambda a, x: a * 4 + x, 0) AS key FROM hits)"""))
def kmer_keys(spark, sf):
    return _hits(spark, sf).select("kmer").distinct().withColumn("key", dna.kmer_key("kmer")).withColumn("back", dna.kmer_text("key", 5))


@query(sql("""SELECT node_id, step, packed, packed // 2048 AS back_id, (packed // 1024) % 2 = 1 AS back_rev, (packed % 1024)::INTEGER AS back_offset
    FROM (SELECT node_id, step, node_id * 2048 + is_rev::INTEGER * 1024 + step AS packed FROM steps)"""))
def packed_positions(spark, sf):
    s = graph(spark, sf).steps.select("node_id", "step", dna.pack_position(F.col("node_id"), F.col("is_rev"), F.col("step")).alias("packed"))
    back = dna.unpack_position(F.col("packed"))
    return s.select("node_id", "step", "packed", back["node_id"].alias("back_id"), back["is_rev"].alias("back_rev"), back["offset"].alias("back_offset"))


# Segments: here the nodes of a supplier-sized range make one segment of up to four nodes.

_SEGMENTS = """, seg AS (SELECT node_id, seq, len, 's' || (node_id - 1) // 4 AS name, ((node_id - 1) // 4) * 4 + 1 AS node_lo FROM nodes WHERE node_id IN (SELECT node_id FROM steps))"""


def _segmented(spark: SparkSession, sf: str) -> g.HapGraph:
    gr = graph(spark, sf)
    lo = (F.expr("(node_id - 1) div 4") * 4 + 1).alias("node_lo")
    s = gr.nodes.select(F.concat(F.lit("s"), F.expr("(node_id - 1) div 4")).alias("name"), lo).distinct().withColumn("node_hi", F.col("node_lo") + 4)
    return g.HapGraph(gr.nodes, gr.paths, gr.steps, s)


@query(sql(_SEGMENTS + """ SELECT node_id, name, coalesce(sum(len) OVER (PARTITION BY name ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_fwd,
    coalesce(sum(len) OVER (PARTITION BY name ORDER BY node_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_rev FROM seg"""))
def segment_offsets(spark, sf):
    return segments.segment_offsets(_segmented(spark, sf))


@query(sql(_SEGMENTS + " SELECT name, node_lo, node_lo + 4 AS node_hi, string_agg(seq, '' ORDER BY node_id) AS seq FROM seg GROUP BY name, node_lo"))
def segment_sequences(spark, sf):
    return segments.segment_sequences(_segmented(spark, sf))


@query(sql(_SEGMENTS + """ SELECT from_id, a.name AS from_name, from_rev, to_id, b.name AS to_name, to_rev FROM edges
    JOIN seg a ON a.node_id = from_id JOIN seg b ON b.node_id = to_id
    WHERE (CASE WHEN NOT from_rev THEN from_id = a.node_lo + 3 ELSE from_id = a.node_lo END) AND (CASE WHEN NOT to_rev THEN to_id = b.node_lo ELSE to_id = b.node_lo + 3 END)"""))
def segment_links(spark, sf):
    return segments.links(_segmented(spark, sf))


@query(sql(_SEGMENTS + """ SELECT path_id, step AS i, name, is_rev FROM steps JOIN seg USING (node_id)
    WHERE CASE WHEN NOT is_rev THEN node_id = node_lo ELSE node_id = node_lo + 3 END"""))
def walk_segments(spark, sf):
    return segments.segment_walks(_segmented(spark, sf))


@query(sql(_SEGMENTS + """, o AS (SELECT node_id, name, coalesce(sum(len) OVER (PARTITION BY name ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f,
    coalesce(sum(len) OVER (PARTITION BY name ORDER BY node_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM seg)
    SELECT name, is_rev, (CASE WHEN is_rev THEN b ELSE f END) + step AS "offset", 1 AS length FROM steps JOIN o USING (node_id)"""))
def translate_back(spark, sf):
    gr = _segmented(spark, sf)
    return segments.translate_back(gr, gr.steps.select("node_id", "is_rev", F.col("step").alias("start"), F.lit(1).alias("length")))


@query("SELECT p_partkey, upper(p_name) AS name, length(p_name) AS n FROM part")
def upper_case_labels(spark, sf):
    (part,) = tables(spark, sf, "part")
    return part.select("p_partkey", F.upper("p_name").alias("name"), F.length("p_name").cast("bigint").alias("n"))


@query(sql(_SEGMENTS + """, outer_links AS (SELECT from_id, from_rev, to_id, to_rev FROM edges JOIN seg a ON a.node_id = from_id JOIN seg b ON b.node_id = to_id
    WHERE (CASE WHEN NOT from_rev THEN from_id = a.node_lo + 3 ELSE from_id = a.node_lo END) AND (CASE WHEN NOT to_rev THEN to_id = b.node_lo ELSE to_id = b.node_lo + 3 END))
    SELECT * FROM outer_links UNION SELECT lo + i, false, lo + i + 1, false FROM (SELECT DISTINCT ((node_id - 1) // 4) * 4 + 1 AS lo FROM nodes), range(3) r(i)"""))
def link_edges(spark, sf):
    gr = _segmented(spark, sf)
    return gfa.link_edges(segments.links(gr), gr.segments)


@query(sql(""" SELECT path_id, k, CASE WHEN k = 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS line FROM (VALUES (0), (1)) r(k),
    (SELECT s.path_id, string_agg(h.oseq, '' ORDER BY s.step) AS seq FROM steps s JOIN handles h ON s.node_id = h.node_id AND s.is_rev = h.is_rev GROUP BY s.path_id)"""))
def sequence_lines(spark, sf):
    return gfa_out.sequence_lines(graph(spark, sf), both=True)


@query(sql(""", n AS (SELECT count(*) AS n FROM paths WHERE sense <> 'HAPLOTYPE')
    SELECT path_id, CASE WHEN sense <> 'HAPLOTYPE' THEN row_number() OVER (PARTITION BY sense = 'HAPLOTYPE' ORDER BY path_id) - 1 ELSE path_id + n END AS handle FROM paths, n"""))
def path_handles(spark, sf):
    return paths.path_handles(graph(spark, sf).paths)


@query(sql(""" SELECT path_id, sample, haplotype, contig, fragment FROM paths WHERE (sense = 'GENERIC' AND contig IN ('g100', 'g200', 'g-1'))
    OR (sense = 'HAPLOTYPE' AND path_id IN (SELECT min(path_id) FROM paths WHERE sense = 'HAPLOTYPE' UNION SELECT max(path_id) FROM paths WHERE sense = 'HAPLOTYPE'))"""))
def paths_by_name(spark, sf):
    p = graph(spark, sf).paths
    ends = p.where("sense = 'HAPLOTYPE'").agg(F.min("path_id").alias("a"), F.max("path_id").alias("b")).first()
    some = paths.described(p.where(F.col("path_id").isin(ends["a"], ends["b"]))).select("name").collect()
    found = [paths.find_path(p, name) for name in ("g100", "g200", "g-1", *(r["name"] for r in some))]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select("path_id", "sample", "haplotype", "contig", "fragment")


@query(sql(_KMERS + """ SELECT kmer, node_id, is_rev, "offset", bit_or(b) AS hap_bits FROM (
    SELECT DISTINCT kmer, id AS node_id, is_rev, "offset", 1::BIGINT AS b FROM hits WHERE id % 2 = 0 UNION ALL SELECT DISTINCT kmer, id, is_rev, "offset", 4 FROM hits WHERE id % 3 = 0) GROUP BY ALL"""))
def merged_indexes(spark, sf):
    hits = _hits(spark, sf).withColumnRenamed("id", "node_id").distinct()
    some = lambda m, bits: hits.where(F.col("node_id") % m == 0).withColumn("hap_bits", F.lit(bits).cast("bigint"))
    return kmers.add_hits(some(2, 1), some(3, 4))


@query(sql(_KMERS + """ SELECT kmer, id AS node_id, is_rev, "offset", CASE WHEN id % 2 = 0 AND "offset" % 3 = 0 THEN id + "offset" END AS payload FROM (SELECT DISTINCT * FROM hits)"""))
def index_payloads(spark, sf):
    hits = _hits(spark, sf).withColumnRenamed("id", "node_id").distinct()
    payload = hits.where("node_id % 2 = 0 and offset % 3 = 0").select("node_id", "is_rev", "offset", (F.col("node_id") + F.col("offset")).alias("payload"))
    return kmers.with_payload(hits, payload)


@query(sql(_SEGMENTS.replace("WHERE node_id IN (SELECT node_id FROM steps)", "") + " SELECT name, node_lo, max(node_id) + 1 AS node_hi FROM seg GROUP BY name, node_lo"))
def imported_translation(spark, sf):
    gr = graph(spark, sf)
    at = gr.nodes.withColumn("name", F.concat(F.lit("s"), F.expr("(node_id - 1) div 4")))
    before = F.coalesce(F.sum("len").over(Window.partitionBy("name").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.from_translation(gr.nodes, at.select("node_id", "name", F.lit(False).alias("is_rev"), before.alias("offset")))
