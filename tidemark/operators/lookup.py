"""Reading keys: single, in batches, and by presence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import EmptyKey, NotFound
from tidemark.operators.merge import live


def point_get(mutations: DataFrame, key) -> DataFrame:
    """The live row of one key, if there is one. The key's filter passes below the aggregate, and reaches the
    scan where the key is a stored column."""
    if not len(key):
        raise EmptyKey("a key has at least a byte")
    return live(mutations.where(F.col("key") == F.lit(key)))


def get(mutations: DataFrame, key):
    """The value of one key; raises :class:`NotFound`."""
    rows = point_get(mutations, key).select("value").take(1)
    if not rows:
        raise NotFound(key)
    return rows[0].value


def multi_get(mutations: DataFrame, keys: DataFrame) -> DataFrame:
    """key, found and value for every row of ``keys``: a left join with the live state.

    Only versions of requested keys are resolved: a semi join comes before the aggregate, which Spark turns
    into a broadcast when the requested keys are few.
    """
    asked = keys.select("key")
    state = live(mutations.join(asked.distinct(), "key", "left_semi"))
    return asked.join(state, "key", "left").select("key", F.col("seq").isNotNull().alias("found"), "value")


def found_keys(mutations: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose key is live."""
    return keys.join(live(mutations).select("key"), "key", "left_semi")


def missing_keys(mutations: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose key was never put or is deleted."""
    return keys.join(live(mutations).select("key"), "key", "left_anti")


def scan(mutations: DataFrame, low=None, high=None, prefix: str | None = None) -> DataFrame:
    """Live rows with low <= key < high, or with a prefix; filters reach the scan as in :func:`point_get`."""
    rows = mutations
    for test in (low is not None and F.col("key") >= F.lit(low), high is not None and F.col("key") < F.lit(high), prefix and F.col("key").startswith(prefix)):
        rows = rows.where(test) if test is not False and test is not None else rows
    return live(rows)


def restart_seek(records: DataFrame, restarts: DataFrame, group: str = "file_num") -> DataFrame:
    """For every record the offset of the last restart key not above its key: an as-of join within each file.

    Both sides are sorted once by file and key and the last restart is carried along, so no pair is formed;
    a file is bounded by the size at which it was written.
    """
    both = records.select(group, "key", F.lit(None).cast("long").alias("offset"), F.lit(1).alias("_side")).unionByName(restarts.select(group, "key", "offset", F.lit(0).alias("_side")))
    carried = F.last("offset", ignorenulls=True).over(Window.partitionBy(group).orderBy("key", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("offset", carried).where("_side = 1").drop("_side")


def restarts_of(records: DataFrame, block_size: int, group: str = "file_num") -> DataFrame:
    """The first key of every block of about ``block_size`` bytes in each file, with its offset.

    A record belongs to the block of its offset divided by the size, so blocks are found by a running sum
    of sizes instead of record after record.
    """
    order = Window.partitionBy(group).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(order), F.lit(0))
    placed = records.select(group, "key", at.alias("offset")).withColumn("_block", F.floor(F.col("offset") / block_size))
    return placed.groupBy(group, "_block").agg(F.min(F.struct("offset", "key")).alias("_first")).select(group, "_first.key", "_first.offset")

