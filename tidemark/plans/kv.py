"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows.

The tables are read as mutations (see operators.views). Tenths of the sequence numbers stand for tiers: 9
is the memtable, 8 the immutable one, 7 to 5 are three files of level 0, 4 to 2 make up level 1 and 1 and
0 level 2. Levels 1 and 2 are newest-wins and cut into four files by ranges of user_id.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import Closed, NotFound
from tidemark.functions import bloom as blooms
from tidemark.functions import codec
from tidemark.operators import compact as compaction
from tidemark.operators import files, lookup, merge, stats, views
from tidemark.options import Options
from tidemark.sources import binary, manifest
from tidemark.sources.shared import folder, stored
from tidemark.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL for the same rows if SQL has it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (WITH + sql) if " ev" in sql else sql
        return f

    return add


#: Names for SQL: the event mutations, their tenths, newest versions and files.
WITH = """
WITH ev0 AS (SELECT printf('u-%08d', user_id) AS key, event_id AS seq, user_id,
  CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, CASE WHEN event_type <> 'error' THEN props END AS value FROM events),
ev AS (SELECT *, CAST(seq * 10 // ((SELECT max(seq) FROM ev0) + 1) AS INTEGER) AS tenth,
  user_id * 4 // ((SELECT max(user_id) FROM ev0) + 1) AS cut FROM ev0),
ev_latest AS (SELECT key, seq, op, value FROM ev QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
ev_live AS (SELECT key, seq, value FROM ev_latest WHERE op = 1),
ev_placed AS (
  SELECT key, seq, op, value, 0 AS level, tenth AS file_num FROM ev WHERE tenth BETWEEN 5 AND 7
    QUALIFY row_number() OVER (PARTITION BY tenth, key ORDER BY seq DESC) = 1
  UNION ALL SELECT key, seq, op, value, 1, 10 + cut FROM ev WHERE tenth BETWEEN 2 AND 4
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
  UNION ALL SELECT key, seq, op, value, 2, 20 + cut FROM ev WHERE tenth <= 1
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
ev_files AS (SELECT level, file_num, min(key) AS min_key, max(key) AS max_key, count(*) AS num_entries,
  CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 17) AS BIGINT) AS size FROM ev_placed GROUP BY ALL)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(_table(spark, sf_dir, "events"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest versions by level and file: level 0 by tenth, levels 1 and 2 cut by key range."""
    events = _table(spark, sf_dir, "events")
    most = (events.agg(F.max("user_id")).first()[0] or 0) + 1
    cut = F.expr(f"cast(substring(key, 3) as bigint) * 4 div {most}")
    ev = views.tiered(views.events(events)).withColumn(
        "level", F.when(F.col("tenth").between(5, 7), 0).when(F.col("tenth").between(2, 4), 1).when(F.col("tenth") <= 1, 2)
    )
    place = F.when(F.col("level") == 0, F.col("tenth")).otherwise(F.col("level") * 10 + cut).cast("long")
    newest = ev.where("level is not null").withColumn("file_num", place).groupBy("level", "file_num", "key").agg(F.max(F.struct("seq", "op", "value")).alias("n"))
    return newest.select("key", "n.*", "level", "file_num")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_meta(_placed(spark, sf_dir), "level", "file_num")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(views.padded("u", "c_custkey").alias("key"))


@query("SELECT key, seq, value FROM ev_live")
def kv_live_state(spark, sf_dir):
    return merge.live(_ev(spark, sf_dir))


@query("SELECT key, seq, op, value FROM ev_latest")
def kv_latest_with_tombstones(spark, sf_dir):
    return merge.latest(_ev(spark, sf_dir)).withColumn("op", F.col("op").cast("int"))


@query("SELECT key, seq, op, value FROM ev_latest")
def kv_latest_by_rank(spark, sf_dir):
    return merge.latest_by_rank(_ev(spark, sf_dir)).withColumn("op", F.col("op").cast("int"))


@query("SELECT key, seq, op, value FROM ev_latest")
def kv_latest_by_join(spark, sf_dir):
    return merge.latest_by_join(_ev(spark, sf_dir)).withColumn("op", F.col("op").cast("int"))


@query(
    "SELECT printf('c-%08d', o_custkey) AS key, o_orderkey AS seq, o_orderpriority AS value FROM orders "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AND o_orderstatus <> 'F'"
)
def kv_live_orders(spark, sf_dir):
    return merge.live(views.orders(_table(spark, sf_dir, "orders")))


@query(
    "SELECT printf('v-%08d', conv_id) AS key, turn AS seq, coalesce(text, '') AS value FROM conversations "
    "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"
)
def kv_live_conversations(spark, sf_dir):
    from tidemark.schema import checked

    return merge.live(checked(views.conversations(_table(spark, sf_dir, "conversations"))))


@query("SELECT url AS key, page_id AS seq, octet_length(encode(html)) AS value_bytes FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1")
def kv_live_pages(spark, sf_dir):
    return merge.live(views.pages(_table(spark, sf_dir, "pages"))).select("key", "seq", F.octet_length("value").cast("long").alias("value_bytes"))


@query("SELECT k.key, l.key IS NOT NULL AS found, l.value FROM (SELECT printf('u-%08d', c_custkey) AS key FROM customer) k LEFT JOIN ev_live l ON k.key = l.key")
def kv_multi_get(spark, sf_dir):
    return lookup.multi_get(_ev(spark, sf_dir), _asked(spark, sf_dir))


@query("SELECT key FROM (SELECT printf('u-%08d', c_custkey) AS key FROM customer) k WHERE NOT EXISTS (SELECT 1 FROM ev_live l WHERE l.key = k.key)")
def kv_not_found(spark, sf_dir):
    return lookup.missing_keys(_ev(spark, sf_dir), _asked(spark, sf_dir))


@query("SELECT key FROM (SELECT printf('u-%08d', c_custkey) AS key FROM customer) k WHERE EXISTS (SELECT 1 FROM ev_live l WHERE l.key = k.key)")
def kv_found(spark, sf_dir):
    return lookup.found_keys(_ev(spark, sf_dir), _asked(spark, sf_dir))


@query(
    "SELECT key, tier, seq, op, value FROM (SELECT *, CASE WHEN tenth >= 5 THEN 9 - tenth WHEN tenth >= 2 THEN 5 ELSE 6 END AS tier FROM ev) "
    "QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, seq DESC) = 1"
)
def kv_tier_first_hit(spark, sf_dir):
    tenth = F.col("tenth")
    tiers = views.tiered(_ev(spark, sf_dir)).withColumn("tier", F.when(tenth >= 5, 9 - tenth).when(tenth >= 2, 5).otherwise(6))
    return merge.first_hit(tiers, "tier").withColumn("op", F.col("op").cast("int"))


@query("SELECT key, seq, value, row_number() OVER (ORDER BY key) - 1 AS rank FROM ev_live")
def kv_sorted_scan(spark, sf_dir):
    return merge.ranked(merge.live(_ev(spark, sf_dir)), "key")


@query(
    "SELECT tenth, count(*) AS num_entries, min(key) AS min_key, max(key) AS max_key FROM "
    "(SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY tenth, key ORDER BY seq DESC) = 1) GROUP BY tenth"
)
def kv_flush_batch(spark, sf_dir):
    newest = views.tiered(_ev(spark, sf_dir)).groupBy("tenth", "key").agg(F.max(F.struct("seq", "op", "value")).alias("n")).select("tenth", "key", "n.*")
    return files.file_meta(newest, "tenth").select("tenth", "num_entries", "min_key", "max_key")


@query("SELECT level, file_num, min_key, max_key, num_entries, size FROM ev_files")
def kv_file_meta(spark, sf_dir):
    return _files(spark, sf_dir)


@query("SELECT level, min(min_key) AS min_key, max(max_key) AS max_key FROM ev_files GROUP BY level")
def kv_level_span(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("level").agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


@query(
    "SELECT l.level, count(f.level) AS files, coalesce(CAST(sum(f.size) AS BIGINT), 0) AS bytes FROM "
    "(SELECT CAST(range AS INTEGER) AS level FROM range(7)) l LEFT JOIN ev_files f ON f.level = l.level GROUP BY l.level"
)
def kv_level_stats(spark, sf_dir):
    return files.level_stats(_files(spark, sf_dir), Options().max_levels)


@query(
    "SELECT a.file_num, b.file_num AS other_num FROM ev_files a JOIN ev_files b ON a.level = 0 AND b.level = 1 "
    "AND a.max_key >= b.min_key AND a.min_key <= b.max_key"
)
def kv_overlap_join(spark, sf_dir):
    meta = stored(_files(spark, sf_dir), "files")
    return files.overlapping(meta.where("level = 0"), meta.where("level = 1"))


@query(
    "SELECT k.key, f.level, f.file_num FROM (SELECT DISTINCT printf('u-%08d', c_custkey) AS key FROM customer) k "
    "JOIN ev_files f ON k.key BETWEEN f.min_key AND f.max_key"
)
def kv_file_prune(spark, sf_dir):
    return files.candidates(_asked(spark, sf_dir).distinct(), _files(spark, sf_dir))


@query(
    "SELECT r.file_num, r.key, max(s.place) AS restart FROM (SELECT file_num, key FROM ev_placed WHERE level = 1) r LEFT JOIN "
    "(SELECT file_num, key, place FROM (SELECT file_num, key, row_number() OVER (PARTITION BY file_num ORDER BY key) - 1 AS place FROM ev_placed WHERE level = 1) "
    "WHERE place % 16 = 0) s ON s.file_num = r.file_num AND s.key <= r.key GROUP BY r.file_num, r.key"
)
def kv_restart_seek(spark, sf_dir):
    from pyspark.sql import Window

    level = _placed(spark, sf_dir).where("level = 1").select("file_num", "key")
    place = F.row_number().over(Window.partitionBy("file_num").orderBy("key")) - 1  # a file is bounded by its size
    restarts = level.select("file_num", "key", place.cast("long").alias("offset")).where("offset % 16 = 0")
    return lookup.restart_seek(level, restarts).withColumnRenamed("offset", "restart")


@query(
    "SELECT level, files, bytes, target, CASE WHEN level = 0 THEN files >= 3 WHEN level < 6 THEN bytes > target ELSE false END AS due FROM "
    "(SELECT l.level, count(f.level) AS files, coalesce(CAST(sum(f.size) AS BIGINT), 0) AS bytes, CASE WHEN l.level = 0 THEN 0 ELSE CAST(2048 * 10 ** (l.level - 1) AS BIGINT) END AS target "
    "FROM (SELECT CAST(range AS INTEGER) AS level FROM range(7)) l LEFT JOIN ev_files f ON f.level = l.level GROUP BY l.level)"
)
def kv_pick_compaction(spark, sf_dir):
    options = Options(l0_compaction_trigger=3, base_level_size=2048)
    return files.compaction_flags(files.level_stats(_files(spark, sf_dir), options.max_levels), options)


@query("SELECT key, seq, op, value FROM ev_placed WHERE level <= 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def kv_compact_l0(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    own = [placed.where(F.col("level") == k).select("key", "seq", "op", "value") for k in (0, 1)]
    return compaction.compact(*own).withColumn("op", F.col("op").cast("int"))


@query("SELECT key, seq, op, value FROM (SELECT * FROM ev_placed QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def kv_compact_last(spark, sf_dir):
    own = _placed(spark, sf_dir).select("key", "seq", "op", "value")
    return compaction.compact(own, last_level=True).withColumn("op", F.col("op").cast("int"))


@query(
    "SELECT count(*) FILTER (op = 1) AS puts, count(*) FILTER (op = 2) AS deletes, max(seq) AS last_seq, (SELECT count(*) FROM ev_live) AS live_keys FROM ev"
)
def kv_write_counters(spark, sf_dir):
    return stats.write_counters(_ev(spark, sf_dir))


@query("SELECT count(*) AS memtable_keys, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 48) AS BIGINT) AS memtable_bytes FROM ev_latest")
def kv_memtable_bytes(spark, sf_dir):
    return stats.memtable_size(_ev(spark, sf_dir))


@query("SELECT key, seq, op, value FROM ev_latest")
def kv_out_of_order_fold(spark, sf_dir):
    shuffled = _ev(spark, sf_dir).repartition(F.xxhash64("seq"))
    return merge.latest(shuffled).withColumn("op", F.col("op").cast("int"))


@query("SELECT key, seq, value FROM ev_live")
def kv_store_lifecycle(spark, sf_dir):
    """Log batches by tenth, a flush after each, compaction, and the live state read from the store."""
    store = Store(spark, folder(spark, "store"), Options(l0_compaction_trigger=3, base_level_size=64 << 10, target_file_size=32 << 10))
    ev = views.tiered(_ev(spark, sf_dir))
    for low, high in ((0, 3), (4, 7), (8, 9)):
        store.import_mutations(ev.where(F.col("tenth").between(low, high)))
        store.flush()
    store.compact_all()
    return store.live().select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value"))


@query("SELECT key, seq, value FROM ev_live WHERE key = 'u-00000042'")
def kv_point_get(spark, sf_dir):
    """The filter is on the number that the key is made of, and so reaches the scan."""
    key = "u-00000042"
    return lookup.point_get(views.events(_table(spark, sf_dir, "events").where(views.numbered("user_id", key))), key)


@query("SELECT key, seq, value FROM ev_live WHERE key >= 'u-00000020' AND key < 'u-00000060'")
def kv_range_scan(spark, sf_dir):
    low, high = "u-00000020", "u-00000060"
    return lookup.scan(views.events(_table(spark, sf_dir, "events").where(views.numbered("user_id", low, high))), low, high)


@query("SELECT key, seq, value FROM ev_live WHERE starts_with(key, 'u-0000001')")
def kv_prefix_scan(spark, sf_dir):
    events = _table(spark, sf_dir, "events").where(views.numbered("user_id", "u-00000010", "u-00000020"))
    return lookup.scan(views.events(events), prefix="u-0000001")


@query("SELECT key, seq, value FROM ev_live")
def kv_compaction_equivalence(spark, sf_dir):
    """The live state over levels that are compacted to one, below what is in memory."""
    ev = views.tiered(_ev(spark, sf_dir))
    rest = ev.where("tenth >= 8").select("key", "seq", "op", "value")
    return merge.live(merge.merge(compaction.compact(_placed(spark, sf_dir).select("key", "seq", "op", "value")), rest))


@query(
    "SELECT p AS percent, value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) v "
    "JOIN (SELECT unnest([50, 99]) AS p) ON r = n * p // 100"
)
def kv_latency_percentiles(spark, sf_dir):
    return merge.index_percentiles(_table(spark, sf_dir, "events"), "value", [50, 99])


# --- Bloom filters ---

#: FNV-1a and a filter's probes in SQL: ``h1`` of every key, and ``at``, the bits of a filter over ``{keys}``.
_PROBES = """, probed AS (SELECT key, h1, (xor(h1, 95::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT AS h2 FROM (
  SELECT key, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(key, ''), lambda c: ord(c)::UHUGEINT)),
    lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h1 FROM ({keys}))),
shape AS (SELECT ((greatest(64, count(DISTINCT key) * 10) + 7) // 8 * 8)::UHUGEINT AS m FROM ev_latest WHERE op = 1),
bits AS (SELECT key, i, ((h1 + i::UHUGEINT * h2) % 18446744073709551616::UHUGEINT) % m AS at FROM probed, shape, range(7) r(i))
"""


@query()
def kv_bloom_hashes(spark, sf_dir):
    """Both hashes of every key, as text: they take all 64 bits."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(0).to_pylist()
            first, second = blooms.fnv1a([k.encode() for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(map(str, first.tolist())), pa.array(map(str, second.tolist()))], names=["key", "h1", "h2"])

    return _ev(spark, sf_dir).select("key").distinct().mapInArrow(run, "key string, h1 string, h2 string")


ORACLE_SQL["kv_bloom_hashes"] = WITH + _PROBES.format(keys="SELECT DISTINCT key FROM ev") + "SELECT key, CAST(h1 AS VARCHAR) AS h1, CAST(h2 AS VARCHAR) AS h2 FROM probed"


@query()
def kv_bloom_probe(spark, sf_dir):
    """Which of the asked keys a filter over the live keys lets pass, false ones included."""
    live = merge.live(_ev(spark, sf_dir)).select(F.col("key").cast("binary").alias("key"))
    filter_ = blooms.build(live, live.count()).encode()  # 10 bits a key of one file: broadcast with the task
    asked = _asked(spark, sf_dir).distinct()
    return asked.select("key", blooms.probe(filter_)(F.col("key").cast("binary")).alias("passed"))


ORACLE_SQL["kv_bloom_probe"] = (
    WITH + _PROBES.format(keys="SELECT DISTINCT key FROM ev UNION SELECT printf('u-%08d', c_custkey) FROM customer")
    + ", full_ AS (SELECT DISTINCT b.at FROM bits b JOIN ev_live l ON l.key = b.key) SELECT b.key, bool_and(f.at IS NOT NULL) AS passed FROM bits b LEFT JOIN full_ f ON f.at = b.at "
    "WHERE b.key IN (SELECT printf('u-%08d', c_custkey) FROM customer) GROUP BY b.key"
)


# --- binary logs and tables ---


@query(
    "SELECT count(*) AS frames, count(*) AS ok, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 25) AS BIGINT) AS bytes, "
    "count(*) FILTER (op = 2) AS deletes, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes FROM ev"
)
def kv_wal_frames(spark, sf_dir):
    path = folder(spark, "wal")
    binary.write_files(binary.encode_logs(binary.by_size(_ev(spark, sf_dir), LOG_BYTES)), path, "log")
    return binary.log_frames(spark, path).agg(
        F.count("*").alias("frames"), F.count_if(F.col("status") == "ok").alias("ok"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.sum("frame_len").alias("bytes"), F.count_if(F.col("op") == 2).alias("deletes"), F.sum(F.when(F.col("op") == 1, F.octet_length("value"))).cast("long").alias("value_bytes"),
    )


@query("SELECT key, seq, op, value FROM ev")
def kv_wal_roundtrip(spark, sf_dir):
    """All mutations, written as logs of a bounded size and replayed from them."""
    path = folder(spark, "wal")
    binary.write_files(binary.encode_logs(binary.by_size(_ev(spark, sf_dir), LOG_BYTES)), path, "log")
    return _plain(binary.read_logs(spark, path))


def _plain(mutations: DataFrame) -> DataFrame:
    return mutations.select(F.col("key").cast("string").alias("key"), "seq", F.col("op").cast("int").alias("op"), F.col("value").cast("string").alias("value"))


#: Bytes of records in a log or table that is written here.
LOG_BYTES = 1 << 20


@query("SELECT level, file_num, num_entries, min_key, max_key FROM ev_files")
def kv_table_roundtrip(spark, sf_dir):
    path = folder(spark, "sst")
    binary.write_files(binary.encode_tables(_placed(spark, sf_dir)), path, "sst")
    meta = binary.read_tables(spark, path).groupBy("file_num").agg(F.count("*").alias("num_entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    level = F.when(F.col("file_num") < 10, 0).otherwise((F.col("file_num") / 10).cast("int"))
    return meta.select(level.alias("level"), "file_num", "num_entries", F.col("min_key").cast("string").alias("min_key"), F.col("max_key").cast("string").alias("max_key"))


@query(
    "SELECT k.key, l.op = 1 AND l.op IS NOT NULL AS found, CASE WHEN l.op = 1 THEN l.value END AS value FROM (SELECT DISTINCT printf('u-%08d', c_custkey) AS key FROM customer) k "
    "LEFT JOIN (SELECT * FROM ev_placed QUALIFY row_number() OVER (PARTITION BY key ORDER BY level, seq DESC) = 1) l ON l.key = k.key"
)
def kv_table_lookup(spark, sf_dir):
    """Batched reads of sorted tables: by key ranges first, then by filters, then in one block of a table."""
    path = folder(spark, "sst")
    placed = stored(_placed(spark, sf_dir), "placed")
    binary.write_files(binary.encode_tables(placed), path, "sst")
    asked = _asked(spark, sf_dir).distinct()
    near = files.candidates(asked, files.file_meta(placed, "level", "file_num"))
    hits = binary.table_get(spark, path, near).where("seq is not null").select(F.col("key").cast("string").alias("key"), "file_num", "seq", "op", "value")
    first = merge.first_hit(hits.join(near, ["key", "file_num"]).drop("file_num"), "level")
    out = asked.join(first, "key", "left")
    found = F.coalesce(F.col("op") == 1, F.lit(False))
    return out.select("key", found.alias("found"), F.when(found, F.col("value").cast("string")).alias("value"))


#: What is done to logs by their number: two cut tails, a last frame with a wrong byte, and a wrong byte before valid frames.
_TAILS = {2: b"\x01\x02\x03", 5: struct.pack("<II", 0, 64) + b"x" * 10}
_BAD_TAIL, _BAD_MIDDLE = 7, 4


def _damaged(spark: SparkSession, sf_dir: str, *, corrupt: bool) -> str:
    """A folder of logs by tenth, some of them damaged as a crash or a disk would."""
    path = folder(spark, "wal")
    encoded = binary.encode_logs(views.tiered(_ev(spark, sf_dir)).withColumnRenamed("tenth", "file_num"))

    def damage(batches):
        pieces = ((num.as_py(), data.as_py()) for batch in batches for num, data in zip(*batch.columns, strict=True))
        for num, own in groupby(pieces, lambda row: row[0]):
            tail = _TAILS.get(num, b"")
            for i, (_, data) in enumerate(own):
                if i == 0 and num == _BAD_TAIL:
                    frame = codec.read_frame(data, 0)
                    tail = data[: frame.length - 1] + bytes([data[frame.length - 1] ^ 255])
                if i == 0 and num == _BAD_MIDDLE and corrupt:
                    data = data[:12] + bytes([data[12] ^ 1]) + data[13:]
                yield binary.piece(num, data)
            if tail:
                yield binary.piece(num, tail)

    binary.write_files(encoded.mapInArrow(damage, "file_num long, content binary"), path, "log")
    return path


_LOG_SQL = (
    "SELECT tenth AS file_num, count(*) AS n, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 25) AS BIGINT) AS good, "
    "CASE tenth WHEN 2 THEN 3 WHEN 5 THEN 18 WHEN 7 THEN arg_min(strlen(key) + coalesce(strlen(value), 0) + 25, seq) ELSE 0 END AS tail FROM ev GROUP BY tenth"
)


@query(f"SELECT CAST(count(*) FILTER (tail > 0) AS INTEGER) AS torn_tails, CAST(sum(tail) AS BIGINT) AS truncated_bytes FROM ({_LOG_SQL})")
def kv_recovery_info(spark, sf_dir):
    return stats.recovery_info(binary.logs(spark, _damaged(spark, sf_dir, corrupt=False)))


@query(f"SELECT CAST(file_num AS BIGINT) AS file_num, CASE WHEN file_num = 4 AND n > 1 THEN 0 ELSE good END AS good, CAST(tail AS BIGINT) AS truncated_bytes, file_num = 4 AND n > 1 AS corrupt FROM ({_LOG_SQL})")
def kv_log_recovery(spark, sf_dir):
    """What replay says of each log: its good bytes, what is cut off, and whether valid frames follow bad bytes."""
    return binary.logs(spark, _damaged(spark, sf_dir, corrupt=True)).select("file_num", "good", "truncated_bytes", "corrupt")


@query("SELECT key, seq, op, value FROM ev")
def kv_torn_replay(spark, sf_dir):
    """Every acknowledged mutation is read from logs whose tails are torn."""
    return _plain(binary.read_logs(spark, _damaged(spark, sf_dir, corrupt=False)))


@query("SELECT key, seq, value FROM ev_live")
def kv_directory_roundtrip(spark, sf_dir):
    """A directory of binary tables with its manifest, written and read back, logs beside them included."""
    path, ev = folder(spark, "directory"), views.tiered(_ev(spark, sf_dir))
    binary.write_directory(merge.latest(ev.where("tenth < 6").select("key", "seq", "op", "value")), path, Options(target_file_size=LOG_BYTES))
    first = manifest.load(manifest.Files(spark, path))["next_file_num"]
    # Tombstones go from a lone level; the versions after it come from logs, whose numbers follow those of the tables.
    after = binary.by_size(ev.where("tenth >= 6").select("key", "seq", "op", "value"), LOG_BYTES).withColumn("file_num", F.col("file_num") + first - 1)
    binary.write_files(binary.encode_logs(after), path, "log")
    found, _ = binary.read_directory(spark, path)
    return _plain(merge.live(found).withColumn("op", F.lit(1))).drop("op")


# --- the store ---

_CUSTOMERS = """
WITH ops AS (SELECT printf('c-%08d', c_custkey) AS key, 1 AS step, 1 AS op, c_name AS value FROM customer
  UNION ALL SELECT printf('c-%08d', c_custkey), 2, 2, NULL FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT printf('c-%08d', c_custkey), 3, 1, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'),
state AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY step DESC) = 1)
"""


def _customers(spark: SparkSession, sf_dir: str, store: Store, after=lambda store: None) -> Store:
    """Puts of all customers, deletes of those in debt, and new values for one segment; ``after`` follows each."""
    rows = _table(spark, sf_dir, "customer").withColumn("key", views.padded("c", "c_custkey"))
    store.put(rows.select("key", F.col("c_name").alias("value")))
    after(store)
    store.delete(rows.where("c_acctbal < 0").select("key"))
    after(store)
    store.put(rows.where("c_mktsegment = 'BUILDING'").select("key", F.col("c_mktsegment").alias("value")))
    after(store)
    return store


def _state(store: Store) -> DataFrame:
    return store.live().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(_CUSTOMERS + "SELECT key, value FROM state WHERE op = 1")
def kv_put_delete(spark, sf_dir):
    return _state(_customers(spark, sf_dir, Store(spark, folder(spark, "store"))))


@query(_CUSTOMERS + "SELECT key, value FROM state WHERE op = 1")
def kv_reopen(spark, sf_dir):
    """What a store says that was opened again: first with all in its log, then with a file below it."""
    path = folder(spark, "store")
    _customers(spark, sf_dir, Store(spark, path))
    Store(spark, path).flush()
    return _state(Store(spark, path))


@query(_CUSTOMERS + "SELECT key, value FROM state WHERE op = 1")
def kv_append_batch(spark, sf_dir):
    """Puts and deletes of one batch are published together; a batch that comes again changes nothing."""
    rows = _table(spark, sf_dir, "customer").withColumn("key", views.padded("c", "c_custkey"))
    op = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_acctbal") < 0, 2).otherwise(1)
    store = Store(spark, folder(spark, "store"))
    for _ in range(2):
        store.append(rows.select("key", op.alias("op"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("value")), stream=("customers", 0))
    if store.manifest["last_seq"] != rows.count():
        raise AssertionError("a batch was appended twice")
    return _state(store)


@query(
    _CUSTOMERS + "SELECT count(*) FILTER (op = 1) AS puts, CAST(2 AS BIGINT) AS gets, count(*) FILTER (op = 2) AS deletes, CAST(1 AS BIGINT) AS flushes, CAST(0 AS BIGINT) AS compactions, "
    "count(*) AS last_seq, (SELECT count(*) FROM ops WHERE step = 3) AS memtable_keys, (SELECT CAST(sum(strlen(key) + strlen(value) + 48) AS BIGINT) FROM ops WHERE step = 3) AS memtable_bytes, "
    "CAST(1 AS BIGINT) AS files, (SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 17) AS BIGINT) FROM "
    "(SELECT * FROM ops WHERE step < 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY step DESC) = 1)) AS bytes FROM ops"
)
def kv_store_stats(spark, sf_dir):
    """All counters after puts, deletes, two reads and a flush of what came before the last puts."""
    store = Store(spark, folder(spark, "store"))
    steps = iter((None, store.flush, None))

    def after(_):
        if step := next(steps):
            step()

    _customers(spark, sf_dir, store, after)
    for key in (b"c-00000001", b"c-nobody"):
        try:
            store.get(key)
        except NotFound:
            pass
    found = store.stats()
    sums = F.aggregate("files_per_level", F.lit(0).cast("long"), lambda a, x: a + x).alias("files"), F.aggregate("bytes_per_level", F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes")
    return found.select("puts", "gets", "deletes", "flushes", "compactions", "last_seq", "memtable_keys", "memtable_bytes", *sums)


@query(
    _CUSTOMERS + ", sizes AS (SELECT step, sum(strlen(key) + coalesce(strlen(value), 0) + 17) AS size FROM ops GROUP BY step) "
    "SELECT count(*) FILTER (size >= 1024) AS flushes, (SELECT count(*) FROM state WHERE op = 1) AS live_keys FROM sizes"
)
def kv_flush_when_full(spark, sf_dir):
    """A log that holds as much as a memtable is flushed before more is written."""
    store = Store(spark, folder(spark, "store"), Options(memtable_size=1024))
    _customers(spark, sf_dir, store, lambda s: s.flush_if_full())
    return spark.createDataFrame([(store.counters["flushes"], store.live().count())], "flushes long, live_keys long")


@query(_CUSTOMERS + "SELECT CAST(1 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS left_over, (SELECT count(*) FROM state WHERE op = 1) AS live_keys")
def kv_close_and_vacuum(spark, sf_dir):
    """A store is closed once, and after compaction and vacuum its folders are those that the snapshot names."""
    path, refused = folder(spark, "store"), 0
    store = _customers(spark, sf_dir, Store(spark, path, Options(l0_compaction_trigger=2)), lambda s: s.flush())
    store.close()
    try:
        store.close()
    except Closed:
        refused += 1
    store = Store(spark, path, Options(l0_compaction_trigger=2))
    store.compact_all()
    store.vacuum(0)
    named = {f["path"].split("/")[0] for f in store.file_rows()}
    left = [n for n in store.files.names("data") if n not in named] + store.files.names("log")
    return spark.createDataFrame([(refused, len(left), store.live().count())], "refused long, left_over long, live_keys long")


# --- streams ---


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream. A streaming source reads folders: the table's own, or a copy if it is a single
    file beside others."""
    path = f"{sf_dir}/events.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        source, path = spark.read.parquet(path), folder(spark, "events")
        source.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path)


def _to_store(spark: SparkSession, newest: DataFrame) -> DataFrame:
    """What a stream of newest versions, written to a store as they change, leaves there."""
    store = Store(spark, folder(spark, "store"))
    writer = newest.writeStream.outputMode("update").option("checkpointLocation", folder(spark, "checkpoint"))
    writer.foreachBatch(lambda batch, _: store.import_mutations(batch)).trigger(availableNow=True).start().awaitTermination()
    return _plain(merge.latest(store.mutations()))


@query("SELECT key, seq, op, value FROM ev_latest")
def kv_stream_latest(spark, sf_dir):
    """The newest versions by a streaming aggregate in update mode, written to a store."""
    from tidemark.streaming.ingest import latest_aggregate

    return _to_store(spark, latest_aggregate(views.events(_stream(spark, sf_dir))))


@query("SELECT key, seq, op, value FROM ev_latest")
def kv_stream_stateful(spark, sf_dir):
    """The same by custom state, which emits a key only when it has changed."""
    from tidemark.streaming.ingest import latest_stateful

    return _to_store(spark, latest_stateful(views.events(_stream(spark, sf_dir))))


@query("SELECT count(*) AS last_seq, count(*) FILTER (op = 1) AS puts, count(*) FILTER (op = 2) AS deletes FROM ev")
def kv_stream_ingest(spark, sf_dir):
    """A stream of puts and deletes into a store; the same stream from its beginning changes nothing."""
    from tidemark.streaming.ingest import ingest

    store = Store(spark, folder(spark, "store"), Options(memtable_size=1 << 16))
    rows = views.events(_stream(spark, sf_dir)).select(F.col("key").cast("binary").alias("key"), "op", F.col("value").cast("binary").alias("value"))
    for _ in range(2):
        ingest(rows, store, folder(spark, "checkpoint"), "events", compact_every=1, once=True).awaitTermination()
    return spark.createDataFrame([(store.manifest["last_seq"], store.counters["puts"], store.counters["deletes"])], "last_seq long, puts long, deletes long")
