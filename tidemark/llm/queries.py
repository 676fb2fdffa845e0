"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, html_extract, media, packing, quality, secret_scan, simhash, token_binary, toxicity
from .common import stored

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE, BYTE_BPE_IDS, END_ID = public_tokenizers.path("byte_bpe_50k.json"), 50_257, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_binary.write_token_file(table(spark, sf_dir, "documents"), BYTE_BPE, END_ID, BYTE_BPE_IDS)
    return token_binary.read_token_file(spark, path, BYTE_BPE_IDS, with_ids=False)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), MULTI_RANKS)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stored(media.encode_media(table(spark, sf_dir, "documents")), "media")
    return media.features(stored(media.fingerprints(kept), "fingerprints"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(stored(chat.expand(conversations.unionByName(more)), "examples"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, END_ID, 1024, with_ids=False)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secret_scan.joined("spans", ("assign", "access", "hex"))
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(base, 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html, op2_token_binary, op3_byte_bpe, op4_simhash, op5_quality, op6_media, op7_chat, op8_toxicity, op9_packing, op10_secrets)
}

#: By query, DuckDB SQL for the same rows. The other operators rest on tokenizers, XXH64, EM, compression,
#: CRC-32 and learned weights, which SQL doesn't have; tests/llm holds them against brute force and round trips.
ORACLE_SQL: dict[str, str] = {
    # A turn takes "### ", role, a line feed, text, "</turn>" and a line feed; each escape takes a character more:
    # of backslashes, of "#" before "##", of "</turn>" and, in roles, of line feeds.
    "op7_chat": r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, length(role) + length(text) + 13 + length(role) - length(replace(role, chr(10), ''))
  + list_sum([length(x) - length(replace(x, '\', '')) + (length(x) - length(replace(x, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(x, '#{3,}'), lambda h: length(h) - 2)), 0) FOR x IN [role, text]]) AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
}
