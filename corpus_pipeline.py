"""The corpus pipeline: raw documents to packed token sequences, five stages of operators of tidemark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet in the
shared folder and rereads it as the next stage's documents. All but the last keep the columns of
``documents``. Null and empty texts fail the quality stage. Rows with a null doc_id are nobody's copies;
of rows that repeat a document the near-duplicate stage keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, packing, quality, secret_scan, simhash, toxicity

TOKENIZER, END_ID, CAPACITY = public_tokenizers.path("byte_bpe_50k.json"), 2, 1024


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the weakly supervised posterior keep."""
    return quality.keep_good(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance doesn't call toxic, by the labels of those that are left."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each SimHash component."""
    return simhash.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return secret_scan.redact_all(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a packed sequence."""
    return packing.pack(docs, TOKENIZER, END_ID, CAPACITY, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: The stages rest on EM, compression and XXH64 fingerprints, which SQL doesn't express; the tests hold
#: the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, f"stage{i}")
    return docs
