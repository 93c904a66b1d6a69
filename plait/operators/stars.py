"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is a minimum by key (combined before the shuffle) and a join back on it. Near the end all links of a large
component have one key. So from LARGE links on both sides of a join are written tables: it is then the only thing that
its shuffles serve, and adaptive execution splits the hot key (fewer links fit any task, and are not written so often).
A table goes as soon as the next one is written. Only linked nodes take part, and neither links nor labels come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.storage import discard, settle

#: A round halves the depth of the trees at least; this is far beyond any table's need, and not settling by then is an error.
ROUNDS = 60
LARGE = 1_000_000


def _star(arcs: DataFrame, large: bool, written) -> DataFrame:
    """arcs u -> v with every neighbour; the neighbours of u point to the least of them (and of u itself). Written."""
    least = written(arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    moved = arcs.where("v > u" if large else "v <= u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = settle(moved.where("a <> b").distinct())
    discard(least)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link to another: root is the least node that it reaches. Null ends link nothing."""
    edges = settle(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} <> {b}").distinct())
    checksum = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    state = edges.agg(*checksum).first()
    for _ in range(ROUNDS):
        written = settle if state[0] > LARGE else (lambda df: df)
        ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        both = written(edges.select(F.inline(ways)))
        large = _star(both, True, written)
        discard(both, edges)
        edges = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False, written)
        discard(large)
        before, state = state, edges.agg(*checksum).first()
        if before == state:
            named = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return named.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
