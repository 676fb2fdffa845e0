"""Newest-wins resolution: the k-way merge of versions, as an aggregate.

The newest version of a key is a maximum, so it is aggregated before the shuffle: each task sends one row
a key at most, and a key that has a third of all versions costs no more than another. Filters on the key
pass below the aggregate; filters on op or value must stay above it, or older versions would reappear.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import DELETE, PUT


def latest(mutations: DataFrame, *also: str) -> DataFrame:
    """The newest version of every key, deletes included. Equal sequence numbers are decided by op and value,
    so the result doesn't depend on the order of rows. ``also`` names columns to carry along."""
    newest = F.max(F.struct("seq", "op", "value", *also)).alias("_newest")
    return mutations.groupBy("key").agg(newest).select("key", "_newest.*")


def latest_by_rank(mutations: DataFrame) -> DataFrame:
    """The same by a window, which Spark cuts to one row a key in every task before the shuffle too."""
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("op"), F.desc_nulls_last("value"))
    return mutations.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest_by_join(mutations: DataFrame) -> DataFrame:
    """The same for wide values: a hash aggregate of the numbers alone, then a semi join back.

    Needs sequence numbers unique within a key. Worth it where values are much wider than keys and
    versions few, since values then aren't sorted by the aggregate.
    """
    newest = mutations.groupBy("key").agg(F.max("seq").alias("seq"))
    return mutations.join(newest, ["key", "seq"], "left_semi").select(mutations.columns)


def live(mutations: DataFrame) -> DataFrame:
    """Keys that hold a value, with it and its sequence number."""
    return latest(mutations).where(F.col("op") == PUT).select("key", "seq", "value")


def merge(*sources: DataFrame) -> DataFrame:
    """The newest version of each key over sources in any order. Tombstones stay."""
    return latest(reduce(DataFrame.unionByName, sources))


def drop_tombstones(mutations: DataFrame) -> DataFrame:
    return mutations.where(F.col("op") != DELETE)


def first_hit(tiers: DataFrame, priority: str) -> DataFrame:
    """What the first tier that has the key says: a COALESCE by ``priority``, lowest first, then newest.

    It equals :func:`latest` as long as newer tiers hold newer versions.
    """
    hit = F.min(F.struct(F.col(priority).alias("_priority"), (-F.col("seq")).alias("_age"), "op", "value")).alias("_hit")
    picked = tiers.groupBy("key").agg(hit)
    return picked.select("key", F.col("_hit._priority").alias(priority), (-F.col("_hit._age")).alias("seq"), "_hit.op", "_hit.value")


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank`` from 0 in the order of columns, without gathering it in one task.

    Ranges are sorted where they lie and written once, since two passes must see the same ranges; the rows
    before a range are a sum over ranges, of which there are as many as partitions.
    """
    from pyspark.sql import Window

    from tidemark.sources.shared import stored

    parts = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")
        ),
        "ranked",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(counts), "_part").withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def index_percentiles(df: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """(percent, value): the value at index floor(n * percent / 100) of the sorted column, exactly."""
    values = df.select(F.col(column).alias("value")).dropna()
    order = ranked(values, "value")
    n = order.count()
    wanted = df.sparkSession.createDataFrame([(p, min(n * p // 100, n - 1)) for p in percents] if n else [], "percent int, rank long")
    return order.join(F.broadcast(wanted), "rank").select("percent", "value")
