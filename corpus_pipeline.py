"""The corpus pipeline: STAGES over documents, each written as Parquet and read again by the next.

1. quality: an ordinal classifier fitted to the labels; poor and toxic documents go.
2. exact_dedup: of equal texts the smallest doc_id stays.
3. near_dedup: SimHashes of 3-word shingles within two bits, by deletion-variant signatures, and all pairs at a similarity of 0.8 of
   their 5-word shingles, by a prefix filter; of texts linked either way the smallest id stays.
4. mixing: temperature mixing by BPE tokens, with each source passed over at least once and at most twice.
5. byte_bpe: token ids of every document, and what they decode to.

All but the last give rows with the columns of documents, whatever their names. A null text is empty: it is scored as
such, equal to other empty texts, near to nothing, and has no tokens; a null source is a source; a null id loses to
any other. Rows that repeat everything go but for one. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plait.llm import byte_bpe, quality
from plait.llm.exact_dedup import exact_dedup
from plait.llm.mixing import mix
from plait.llm.near_dedup import near_dedup
from plait.storage import shared_folder

TOKENIZER = "byte_bpe_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.grade_of_labels())
    return quality.select(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs, keep="smallest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, narrow=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, repetition=2.0)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "source", "text")
    return byte_bpe.encode(rows, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, digests=True).drop("text")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("byte_bpe", bpe_stage)]

#: A fitted model and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages in between are written below the shared checkpoint folder."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
