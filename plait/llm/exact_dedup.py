"""Exact dedup by content sort.

Sampled splitters range-partition the rows on (head of the text, hash of the text), external sorting
places equal texts next to each other, and neighbours are compared in full: the Window below cuts its
sorted rows where the whole text changes. The ordering keys are short, so Spark's splitter sample on the
driver stays small however long the texts are, and many texts with the same head still spread by hash.

Hot groups. A text that holds a large share of a row sample gets a salt from its id, so its copies fall into
many neighbouring ranges; what the ranges say of it is replaced by one pre-aggregated row per hot text. The
sample only moves rows between tasks: the result is the same whichever texts it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.common import fan_out, free_prefix

#: Characters of a text's head in the sort key; sampled rows and splits of a hot text for each partition.
HEAD, SAMPLE, SPLITS = 48, 64, 4
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def _hot(keyed: DataFrame, key: str, n: int) -> list[int]:
    """Hashes of the texts with over a quarter of a partition's share of the rows; 4n at most, by counting."""
    rows = keyed.count()
    share = min(1.0, SAMPLE * n / max(rows, 1))
    drawn = keyed.select(key) if share == 1.0 else keyed.select(key).sample(share, seed=7)
    least = max(2, SAMPLE // 4)
    return [r[0] for r in drawn.groupBy(key).count().where(F.col("count") > least).orderBy(F.desc("count")).limit(SPLITS * n).collect()]


def groups_of_equal_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Column | None = None
) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 beside its own columns.

    keep: of equal texts the row with the "smallest" or "largest" id stays. normalise: an expression over
    docs to compare instead of the text (None: the text unchanged). A null text is empty. A null id loses to
    any other; of rows with the same text and id exactly one is kept. An empty table gives an empty result;
    columns of docs named like a result column are replaced.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    n, own = fan_out(docs.sparkSession), free_prefix(docs)
    best, first = (F.min, F.asc_nulls_last) if keep == "smallest" else (F.max, F.desc_nulls_last)
    text = F.coalesce((F.col(text_col) if normalise is None else normalise).cast("string"), F.lit(""))
    mine = [c for c in docs.columns if c.lower() not in RESULTS]
    keyed = docs.select(*mine, text.alias(own + "text")).withColumn(own + "hash", F.xxhash64(own + "text"))
    hot = _hot(keyed, own + "hash", n)
    is_hot = F.col(own + "hash").isin(hot) if hot else F.lit(False)
    # The Window's keys hold all keys of the ranges, so it needs no second exchange (a constant salt would be folded away).
    keys = [own + "head", own + "hash", *[own + "salt"] * bool(hot)]
    salt = F.when(is_hot, F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(SPLITS * n))).otherwise(F.lit(0).cast("bigint"))
    spread = keyed.withColumns({own + "head": F.substring(own + "text", 1, HEAD)} | ({own + "salt": salt} if hot else {})).repartitionByRange(n, *keys)
    same = Window.partitionBy(*keys, own + "text")
    found = spread.withColumns(
        {
            own + "rank": F.row_number().over(same.orderBy(first(id_col))),
            own + "keep": best(id_col).over(same),
            own + "size": F.count(F.lit(1)).over(same),
            own + "sha": F.sha2(own + "text", 256),
        }
    )
    if hot:
        # At most SPLITS * n rows (plus hash collisions among them), of fixed width: the digest stands for the text.
        whole = (
            keyed.where(is_hot)
            .select(F.sha2(own + "text", 256).alias(own + "hot"), F.col(id_col).alias(own + "id"))
            .groupBy(own + "hot")
            .agg(best(own + "id").alias(own + "hot_keep"), F.count(F.lit(1)).alias(own + "hot_size"))
        )
        found = found.join(F.broadcast(whole), found[own + "sha"] == whole[own + "hot"], "left")
        split = F.col(own + "hot").isNotNull()
        keep_id, size = F.when(split, F.col(own + "hot_keep")).otherwise(F.col(own + "keep")), F.when(split, F.col(own + "hot_size")).otherwise(F.col(own + "size"))
    else:
        keep_id, size = F.col(own + "keep"), F.col(own + "size")
    return found.select(
        *mine,
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        ((F.col(own + "rank") == 1) & F.col(id_col).eqNullSafe(keep_id)).alias("kept"),
        F.col(own + "sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Column | None = None) -> DataFrame:
    """The rows of docs that stay, with the columns of docs (those named like a result of groups_of_equal_texts as well)."""
    own = free_prefix(docs)
    safe = {c: own + c if c.lower() in RESULTS else c for c in docs.columns}
    found = groups_of_equal_texts(docs.withColumnsRenamed(safe), safe[id_col], safe[text_col], keep, normalise)
    return found.where("kept").select(*(F.col(name).alias(c) for c, name in safe.items()))
