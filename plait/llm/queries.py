"""Queries over the driver's tables, one for each training-data operator, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm import byte_bpe, quality
from plait.llm.chat_format import REPLY, link_tool_calls, turns_as_calls
from plait.llm.common import table
from plait.llm.exact_dedup import groups_of_equal_texts
from plait.llm.mixing import mix_plan
from plait.llm.sharding import shard_documents
from plait.llm.simhash import simhash_components
from plait.llm.substring_dedup import substring_dedup
from plait.llm.token_output import read_shards, training_order, write_shards
from plait.llm.topk_search import exact_top_k
from plait.storage import shared_folder


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    order = training_order(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    out = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(order, out)
    return order.places().join(read_shards(spark, out), "slot", "left").withColumn("record_sha256", F.lower(F.hex("record_sha256")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"), target_entropy=0.97, repetition=4.0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), width=3)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"), width=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(turns_as_calls(table(spark, sf_dir, "conversations")), REPLY)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups_of_equal_texts(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.grade_of_labels())
    return quality.score(docs, model).drop("text")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_quality, op3_exact_topk, op4_token_output, op5_mixing, op6_simhash, op7_substring_dedup, op8_sharding, op9_chat_format, op10_exact_dedup)}

ORACLE_SQL = {
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
    """,
    "op7_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (
            SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d
        ), windows AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY sha256(array_to_string(w[i:i + 34], ' '))) AS n FROM starts
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows WHERE n > 1
        ), words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
            FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op9_chat_format": """
        WITH m AS (
            SELECT conv_id, turn, role, text, role = 'user' AS is_call,
                   CASE WHEN role = 'assistant' THEN turn - 1 END AS asked FROM conversations
        ), calls AS (SELECT DISTINCT conv_id, turn FROM m WHERE is_call),
        answers AS (SELECT DISTINCT conv_id, asked FROM m WHERE asked IS NOT NULL)
        SELECT m.conv_id, m.turn, m.role, c.turn AS call_turn, is_call::BIGINT AS n_calls,
               (is_call AND a.conv_id IS NOT NULL)::BIGINT AS n_answered,
               CASE WHEN is_call AND text IS NULL THEN 'prompt: missing' WHEN is_call AND length(text) > 400 THEN 'prompt: too long'
                    WHEN is_call AND text = '' THEN 'prompt: too short' ELSE '' END AS errors,
               coalesce(c.turn, m.turn) AS order_turn, (c.turn IS NOT NULL)::BIGINT AS depth,
               '{"content":' || CASE WHEN is_call OR text IS NULL THEN 'null' ELSE to_json(text)::VARCHAR END
               || ',"role":' || to_json(m.role)::VARCHAR
               || CASE WHEN c.turn IS NOT NULL THEN ',"tool_call_id":"call:' || m.asked || '"' ELSE '' END
               || CASE WHEN is_call THEN ',"tool_calls":[{"arguments":{' ||
                      CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || to_json(text)::VARCHAR || ',' END
                      || '"turn":' || m.turn || '},"id":"call:' || m.turn || '","name":"reply"}]' ELSE '' END || '}' AS message
        FROM m LEFT JOIN calls c ON m.conv_id = c.conv_id AND m.asked = c.turn
        LEFT JOIN answers a ON m.conv_id = a.conv_id AND m.turn = a.asked
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
