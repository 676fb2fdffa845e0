"""Canonical schemas of the mutation model, and checks that rows keep to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The operation codes of a mutation.
PUT, DELETE = 1, 2

MUTATION = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType()),
    ]
)
LIVE = T.StructType([*MUTATION.fields[:2], T.StructField("value", T.BinaryType(), False)])
FILES = T.StructType(
    [
        T.StructField("file_num", T.LongType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("min_key", T.BinaryType()),
        T.StructField("max_key", T.BinaryType()),
        T.StructField("num_entries", T.LongType()),
    ]
)
RECOVERY = T.StructType([T.StructField("torn_tails", T.IntegerType()), T.StructField("truncated_bytes", T.LongType())])


def checked(mutations: DataFrame) -> DataFrame:
    """``mutations`` with nulls normalised and rows outside the model raising when they are read.

    Keys are not empty, operations are PUT or DELETE, sequence numbers fit 63 bits. A put without a value
    holds the empty value; only a delete holds null.
    """
    empty = F.length("key") > 0
    known = F.col("op").isin(PUT, DELETE)
    zero = F.lit("") if mutations.schema["value"].dataType == T.StringType() else F.lit(b"")
    guard = F.when(empty & known & (F.col("seq") >= 0), F.col("key")).otherwise(
        F.raise_error(F.lit("a mutation needs a key that isn't empty, an operation 1 or 2, and a sequence number"))
    )
    return mutations.select(
        guard.cast(mutations.schema["key"].dataType).alias("key"), F.col("seq").cast("long"), F.col("op").cast("byte").alias("op"),
        F.when(F.col("op") == PUT, F.coalesce("value", zero)).alias("value"),
    )
