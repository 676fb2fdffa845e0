"""Counters over mutations and recoveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.merge import latest
from tidemark.schema import DELETE, PUT

#: Fixed value: bytes that a memtable counts for an entry besides key and value.
ENTRY_BYTES = 48


def write_counters(mutations: DataFrame) -> DataFrame:
    """puts, deletes, last_seq and live_keys. One pass: counts and newest versions come from the same groups."""
    keys = mutations.groupBy("key").agg(
        F.count_if(F.col("op") == PUT).alias("puts"), F.count_if(F.col("op") == DELETE).alias("deletes"), F.max(F.struct("seq", "op")).alias("newest")
    )
    return keys.agg(
        F.coalesce(F.sum("puts"), F.lit(0)).alias("puts"), F.coalesce(F.sum("deletes"), F.lit(0)).alias("deletes"),
        F.coalesce(F.max("newest.seq"), F.lit(0)).alias("last_seq"), F.count_if(F.col("newest.op") == PUT).alias("live_keys"),
    )


def memtable_size(mutations: DataFrame) -> DataFrame:
    """memtable_keys, tombstones included, and memtable_bytes over the newest version of each key."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY_BYTES
    return latest(mutations).agg(F.count("*").alias("memtable_keys"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("memtable_bytes"))


def recovery_info(logs: DataFrame) -> DataFrame:
    """torn_tails and truncated_bytes over replayed logs, a row a log."""
    return logs.agg(
        F.count_if(F.col("truncated_bytes") > 0).cast("int").alias("torn_tails"), F.coalesce(F.sum("truncated_bytes"), F.lit(0)).cast("long").alias("truncated_bytes")
    )
