"""A haplotype graph over the driver's tables: orders are paths, parts are nodes, line items are steps.

sql() has the same view in SQL. Node ids are part keys plus one, a step is reversed if the item was returned; labels are
the letters A, C, G and T of a part's key digits, name, type and brand.

That graph is one component with cycles. `layers` is a second one over the same nodes: the parts fall into LAYERS classes by
their key, and a supplier's parts of a class, in order, are a path. So it has many components, which are acyclic but
for each fifth one, where steps may be reversed; the last ones have no named paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plait.operators.graph import HapGraph
from plait.operators.paths import sense_of

STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]

LAYERS = 50

_MAIN = """
steps AS (
    SELECT l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_extendedprice, l_shipdate, l_quantity) - 1 AS step, l_partkey + 1 AS node_id, l_returnflag = 'R' AS is_rev FROM lineitem
), """

_MAIN_PATHS = """paths AS (
    SELECT o_orderkey AS path_id, CASE WHEN o_orderkey % 100 = 0 THEN '_gbwt_ref' ELSE 'c' || o_custkey END AS sample,
           CASE WHEN o_orderkey % 100 = 0 THEN 'g' || o_orderkey ELSE o_orderpriority END AS contig,
           CASE WHEN o_orderkey % 100 <> 0 THEN o_orderkey % 2 + 1 END AS haplotype,
           CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE o_orderkey END AS fragment,
           CASE WHEN o_orderkey % 100 = 0 THEN 'GENERIC' WHEN o_custkey % 50 = 0 THEN 'REFERENCE' ELSE 'HAPLOTYPE' END AS sense
    FROM orders
), """

_LAYERS = f"""
visits AS (
    SELECT l_suppkey AS supp, l_partkey + 1 AS node_id, (l_partkey + 1) % {LAYERS} AS c, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL
), steps AS (
    SELECT supp * {LAYERS} + c AS path_id, row_number() OVER (PARTITION BY supp, c ORDER BY node_id) - 1 AS step, node_id, r AND c % 5 = 0 AS is_rev FROM visits
), """

_LAYERS_PATHS = f"""named AS (
    SELECT DISTINCT supp, c, supp * {LAYERS} + c AS path_id, supp % 33 = 0 AND c < {LAYERS * 4 // 5} AS generic, supp % 10 = 1 AND c < {LAYERS * 3 // 5} AS reference FROM visits
), paths AS (
    SELECT path_id, CASE WHEN generic THEN '_gbwt_ref' WHEN reference THEN 'ref' || supp ELSE 's' || supp END AS sample,
           CASE WHEN generic THEN 'g' || path_id ELSE 'k' || c END AS contig, CASE WHEN NOT generic AND supp % 7 > 0 THEN supp % 2 + 1 END AS haplotype,
           0 AS fragment, CASE WHEN generic THEN 'GENERIC' WHEN reference THEN 'REFERENCE' ELSE 'HAPLOTYPE' END AS sense
    FROM named
), """

_REST = """nodes AS (
    SELECT node_id, seq, length(seq) AS len FROM (
        SELECT p_partkey + 1 AS node_id, concat(translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ACGTACGTAC'),
               regexp_replace(upper(concat(p_name, p_type, p_brand)), '[^ACGT]', '', 'g')) AS seq FROM part)
), pairs AS (
    SELECT node_id AS a, is_rev AS ar, lead(node_id) OVER w AS b, lead(is_rev) OVER w AS br FROM steps
    WINDOW w AS (PARTITION BY path_id ORDER BY step)
), edges_bi AS (
    SELECT a AS from_id, ar AS from_rev, b AS to_id, br AS to_rev FROM pairs WHERE b IS NOT NULL
    UNION SELECT b, NOT br, a, NOT ar FROM pairs WHERE b IS NOT NULL
), edges AS (
    SELECT * FROM edges_bi WHERE CASE WHEN NOT from_rev THEN to_id >= from_id ELSE to_id > from_id OR (to_id = from_id AND NOT to_rev) END
), handles AS (
    SELECT node_id, r.is_rev, CASE WHEN r.is_rev THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS oseq, len
    FROM nodes, (VALUES (false), (true)) r(is_rev)
), sized AS (
    SELECT *, count(*) OVER (PARTITION BY path_id) AS n FROM steps
), steps_bi AS (
    SELECT path_id, 0 AS ori, step, node_id, is_rev FROM sized UNION ALL SELECT path_id, 1, n - 1 - step, node_id, NOT is_rev FROM sized
), placed AS (
    SELECT s.*, n.len, coalesce(sum(n.len) OVER (PARTITION BY path_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bp_offset
    FROM steps s JOIN nodes n USING (node_id)
)"""


def sql(body: str, recursive: bool = False, layered: bool = False) -> str:
    """body over the tables of the view; it may begin with further WITH parts, after a comma."""
    parts = (_LAYERS + _LAYERS_PATHS if layered else _MAIN + _MAIN_PATHS) + _REST
    return f"WITH {'RECURSIVE ' * recursive}{parts.strip()}{body if body.lstrip().startswith(',') else ' ' + body}"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = tables(spark, sf_dir, "part")
    letters = F.regexp_replace(F.upper(F.concat("p_name", "p_type", "p_brand")), "[^ACGT]", "")
    seq = F.concat(F.translate(F.col("p_partkey").cast("string"), "0123456789", "ACGTACGTAC"), letters)
    return part.select((F.col("p_partkey") + 1).alias("node_id"), seq.alias("seq")).withColumn("len", F.length("seq").cast("bigint"))


def graph(spark: SparkSession, sf_dir: str) -> HapGraph:
    lineitem, orders = tables(spark, sf_dir, "lineitem", "orders")
    order = Window.partitionBy("l_orderkey").orderBy(*STEP_ORDER)
    steps = lineitem.select(
        F.col("l_orderkey").alias("path_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("step"),
        (F.col("l_partkey") + 1).alias("node_id"),
        (F.col("l_returnflag") == "R").alias("is_rev"),
    )
    generic = F.col("o_orderkey") % 100 == 0
    sample = F.when(generic, "_gbwt_ref").otherwise(F.concat(F.lit("c"), "o_custkey"))
    paths = orders.select(
        F.col("o_orderkey").alias("path_id"),
        sample.alias("sample"),
        F.when(generic, F.concat(F.lit("g"), "o_orderkey")).otherwise(F.col("o_orderpriority")).alias("contig"),
        F.when(~generic, F.col("o_orderkey") % 2 + 1).alias("haplotype"),
        F.when(generic, F.lit(0)).otherwise(F.col("o_orderkey")).cast("bigint").alias("fragment"),
        sense_of(sample, F.col("o_custkey") % 50 == 0).alias("sense"),
    )
    return HapGraph(_nodes(spark, sf_dir), paths, steps)


def layers(spark: SparkSession, sf_dir: str) -> HapGraph:
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    visits = lineitem.groupBy(F.col("l_suppkey").alias("supp"), (F.col("l_partkey") + 1).alias("node_id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r")).withColumn("c", F.col("node_id") % LAYERS)
    path_id = (F.col("supp") * LAYERS + F.col("c")).alias("path_id")
    order = Window.partitionBy("supp", "c").orderBy("node_id")
    steps = visits.select(path_id, (F.row_number().over(order) - 1).cast("bigint").alias("step"), "node_id", (F.col("r") & (F.col("c") % 5 == 0)).alias("is_rev"))
    generic, reference = (F.col("supp") % 33 == 0) & (F.col("c") < LAYERS * 4 // 5), (F.col("supp") % 10 == 1) & (F.col("c") < LAYERS * 3 // 5)
    sample = F.when(generic, "_gbwt_ref").when(reference, F.concat(F.lit("ref"), "supp")).otherwise(F.concat(F.lit("s"), "supp"))
    named = lineitem.select(F.col("l_suppkey").alias("supp"), ((F.col("l_partkey") + 1) % LAYERS).alias("c")).distinct()
    paths = named.select("supp", "c", path_id).select(
        "path_id",
        sample.alias("sample"),
        F.when(generic, F.concat(F.lit("g"), "path_id")).otherwise(F.concat(F.lit("k"), "c")).alias("contig"),
        F.when(~generic & (F.col("supp") % 7 > 0), F.col("supp") % 2 + 1).alias("haplotype"),
        F.lit(0).cast("bigint").alias("fragment"),
        sense_of(sample, reference).alias("sense"),
    )
    return HapGraph(_nodes(spark, sf_dir), paths, steps)
