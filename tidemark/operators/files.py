"""File metadata: what each file spans, which files overlap or may hold a key, and what to compact next.

A files table has a row for each file of a snapshot, and the store's manifest holds all of it, so it is
small by construction; still it is broadcast only below BROADCAST_FILES rows.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.options import Options

#: A files row takes about 200 bytes: this many are 20 MB.
BROADCAST_FILES = 100_000
#: Fixed value: bytes of a record besides key and value.
RECORD_BYTES = 17


def record_size(key: str = "key", value: str = "value"):
    """Logical bytes of a record."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + RECORD_BYTES).cast("long")


def file_meta(records: DataFrame, *by: str) -> DataFrame:
    """min_key, max_key, num_entries and size of each file."""
    return records.groupBy(*by).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("num_entries"), F.sum(record_size()).alias("size")
    )


def small(files: DataFrame, limit: int = BROADCAST_FILES) -> DataFrame:
    """``files`` marked for broadcast, if their number allows it."""
    return F.broadcast(files) if files.count() <= limit else files


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of files whose closed key ranges meet: (file_num, other_num).

    Metadata against metadata. On disjoint levels a file meets few others; the condition is the join.
    """
    a, b = left.alias("a"), small(right).alias("b")
    meets = (F.col("a.max_key") >= F.col("b.min_key")) & (F.col("a.min_key") <= F.col("b.max_key"))
    return a.join(b, meets).select(F.col("a.file_num").alias("file_num"), F.col("b.file_num").alias("other_num"))


def candidates(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(key, level, file_num) of files whose range holds the key: at most one a level below level 0.

    Every key looks its file up by binary search in each level's sorted ranges, as arrays that all tasks
    share; level 0, whose files overlap, is walked. No key meets files that can't hold it.
    """
    rows = files.select("level", "file_num", "min_key", "max_key").collect()  # the manifest's size
    if len(rows) > BROADCAST_FILES * 10:
        raise ValueError(f"{len(rows)} files: compact first, or prune by the manifest")
    fresh = [(r.min_key, r.max_key, r.file_num) for r in rows if r.level == 0]
    deep: dict[int, tuple[list, list]] = {}
    for r in sorted((r for r in rows if r.level > 0), key=lambda r: (r.level, r.min_key)):
        lows, rest = deep.setdefault(r.level, ([], []))
        lows.append(r.min_key)
        rest.append((r.max_key, r.file_num))

    def search(batches):
        import pyarrow as pa

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            out = ([], [], [])
            for key in batch.column(0).to_pylist():
                hits = [(0, n) for low, high, n in fresh if low <= key <= high]
                for level, (lows, others) in deep.items():
                    at = bisect_right(lows, key) - 1
                    if at >= 0 and key <= others[at][0]:
                        hits.append((level, others[at][1]))
                for level, n in hits:
                    for column, x in zip(out, (key, level, n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], names=["key", "level", "file_num"])

    kind = keys.schema["key"].dataType.simpleString()
    return keys.select("key").where("key is not null").mapInArrow(search, f"key {kind}, level int, file_num long")


def level_stats(files: DataFrame, max_levels: int) -> DataFrame:
    """files and bytes of every level, empty ones included."""
    levels = files.sparkSession.range(max_levels).select(F.col("id").cast("int").alias("level"))
    found = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return levels.join(F.broadcast(found), "level", "left").select("level", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def compaction_flags(stats: DataFrame, options: Options) -> DataFrame:
    """For every level its target and whether it asks for compaction: level 0 by files, others by bytes.

    The last level never does.
    """
    level = F.col("level")
    target = F.when(level == 0, F.lit(0)).otherwise(F.lit(options.base_level_size) * F.pow(F.lit(options.level_size_multiplier), level - 1)).cast("long")
    due = F.when(level == 0, F.col("files") >= options.l0_compaction_trigger).when(level < options.max_levels - 1, F.col("bytes") > target).otherwise(F.lit(False))
    return stats.select("level", "files", "bytes", target.alias("target"), due.alias("due"))


def pick(files: list[dict], options: Options) -> tuple[int, list[dict], list[dict]] | None:
    """(level, inputs, overlaps) of the next compaction over manifest rows, or None.

    Level 0 goes whole with what it spans of level 1; else the first level over its size gives its files of the
    lowest keys, as many as bring it back to its size. So each level is compacted once however many files it is
    over by, and the number of compactions is bounded by that of levels.
    """
    levels: dict[int, list[dict]] = {}
    for f in sorted(files, key=lambda f: (f["min_key"], f["file_num"])):
        levels.setdefault(f["level"], []).append(f)

    def with_overlaps(level: int, inputs: list[dict]) -> tuple[int, list[dict], list[dict]]:
        low, high = min(f["min_key"] for f in inputs), max(f["max_key"] for f in inputs)
        return level, inputs, [f for f in levels.get(level + 1, []) if f["max_key"] >= low and f["min_key"] <= high]

    fresh = levels.get(0, [])
    if len(fresh) >= options.l0_compaction_trigger:
        return with_overlaps(0, fresh)
    for level in range(1, options.max_levels - 1):
        own = levels.get(level, [])
        over = sum(f["size"] for f in own) - options.level_target_size(level)
        if over > 0:
            before = accumulate((f["size"] for f in own), initial=0)  # bytes of the files before each
            return with_overlaps(level, [f for f, b in zip(own, before, strict=False) if b < over])
    return None
