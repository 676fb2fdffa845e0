"""Mutation views over relational tables: rows read as versions of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import DELETE, PUT


def mutations(df: DataFrame, key, seq, value, deleted=None) -> DataFrame:
    """A mutation view of ``df``: columns for key, sequence number and value, and when a row is a delete."""
    op = F.when(deleted, DELETE).otherwise(PUT) if deleted is not None else F.lit(PUT)
    return df.select(key.alias("key"), seq.cast("long").alias("seq"), op.cast("byte").alias("op"), F.when(op == PUT, value).alias("value"))


def padded(prefix: str, column: str):
    """An order-preserving text key of a number."""
    return F.format_string(f"{prefix}-%08d", F.col(column))


def numbered(column: str, low: str, high: str | None = None):
    """The test of a padded key's bounds (low <= key < high, or key = low) on the number it is made of, which,
    unlike the key, the scan can filter by. For numbers of up to eight digits, whose keys sort as they do."""
    own, number = F.col(column), lambda key: F.lit(int(key.rsplit("-", 1)[1]))
    return own == number(low) if high is None else (own >= number(low)) & (own < number(high))


def events(df: DataFrame) -> DataFrame:
    return mutations(df, padded("u", "user_id"), F.col("event_id"), F.col("props"), F.col("event_type") == "error")


def orders(df: DataFrame) -> DataFrame:
    return mutations(df, padded("c", "o_custkey"), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F")


def conversations(df: DataFrame) -> DataFrame:
    return mutations(df, padded("v", "conv_id"), F.col("turn"), F.col("text"))


def pages(df: DataFrame) -> DataFrame:
    return mutations(df, F.col("url"), F.col("page_id"), F.col("html"))


def tiered(df: DataFrame) -> DataFrame:
    """``df`` with ``tenth``, 0 to 9 by sequence number: ranges of age that stand for tiers of storage."""
    most = df.agg(F.max("seq")).first()[0] or 0
    return df.withColumn("tenth", F.expr(f"cast(seq * 10 div {most + 1} as int)"))
