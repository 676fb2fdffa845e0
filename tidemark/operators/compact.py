"""Compaction as a function of DataFrames: union, newest-wins, tombstones at the bottom, ranges of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.merge import drop_tombstones, latest


def compact(*inputs: DataFrame, last_level: bool = False) -> DataFrame:
    """The inputs' newest versions. Tombstones go only if nothing older can lie below."""
    merged = latest(reduce(DataFrame.unionByName, inputs))
    return drop_tombstones(merged) if last_level else merged


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """``n_differences`` between two states of (key, seq, value): rows of either that the other lacks."""
    a = before.select("key", "seq", "value", F.lit(1).alias("_side"))
    b = after.select("key", "seq", "value", F.lit(-1).alias("_side"))
    uneven = a.unionByName(b).groupBy("key", "seq", "value").agg(F.sum("_side").alias("_n")).where("_n <> 0")
    return uneven.agg(F.count("*").alias("n_differences"))
