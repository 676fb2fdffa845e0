"""Binary logs and sorted tables as DataFrames, read and written file by file.

Files are read with Spark's ``binaryFile``, so any store that Spark reads will do; each file is parsed
where it lies, in order, which is all the order that a log needs, as versions are resolved by number.
Files are written in pieces, and large ones read through a window where pyarrow reaches them (elsewhere
they come whole), so that a worker holds a few pieces and batches of rows however large a file is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import CorruptLog
from tidemark.functions import codec
from tidemark.functions.codec import Mutation
from tidemark.operators.files import record_size
from tidemark.options import Options
from tidemark.schema import MUTATION
from tidemark.sources import manifest

_MUTATION = [("key", pa.binary()), ("seq", pa.int64()), ("op", pa.int8()), ("value", pa.binary())]
_MUTATION_DDL = "key binary, seq long, op byte, value binary"
ROWS, KEYS_A_TASK = 8192, 100_000
#: Bytes of a piece that is written or of a window that is read, and of a file that is read whole.
PIECE, WHOLE = 1 << 18, 4 << 20


def _files(spark: SparkSession, path: str | list[str], suffix: str) -> DataFrame:
    """(file_num, path, content) of files whose name is a number and a suffix; other names are passed over. Files
    of more than WHOLE bytes that pyarrow reaches have a path, the others content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path)
    num = F.regexp_extract("path", rf"(\d+)\.{suffix}$", 1)
    named = found.where(num != "")
    whole = named.select(num.cast("long").alias("file_num"), F.lit(None).cast("string").alias("path"), "content", "length")
    if not _reached(_uri(spark, path if isinstance(path, str) else path[0])):
        return whole.drop("length")
    large = named.where(F.col("length") > WHOLE).select(num.cast("long").alias("file_num"), "path", F.lit(None).cast("binary").alias("content"))
    return whole.where(F.col("length") <= WHOLE).drop("length").unionByName(large)


def _uri(spark: SparkSession, path: str) -> str:
    """A path as Spark gives it (a path or a URI such as ``file:/x``) as a URI."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _store(uri: str) -> tuple:
    """pyarrow's file system of a URI and the path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _reached(uri: str) -> bool:
    from pyarrow import fs

    try:
        store, at = _store(uri)
        return store.get_file_info(at).type != fs.FileType.NotFound
    except (pa.ArrowException, OSError, ValueError):
        return False


class Pieces:
    """The bytes of a file by slices, read through a window."""

    def __init__(self, uri: str):
        store, at = _store(uri)
        self.file = store.open_input_file(at)
        self.size, self.at, self.held = self.file.size(), 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, own: slice) -> bytes:
        low, high, _ = own.indices(self.size)
        if low < self.at or high > self.at + len(self.held):
            self.at, self.held = low, self.file.read_at(max(PIECE, high - low), low)
        return self.held[low - self.at : max(low, high) - self.at]


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes | Pieces]]:
    """The files of a batch of :func:`_files`, one by one."""
    for num, path, content in zip(*batch.columns, strict=True):
        yield num.as_py(), content.as_py() if content.is_valid else Pieces(path.as_py())


def _out(columns: list[list], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _split(rows: Iterable[tuple], fields: list[tuple]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while own := list(islice(rows, ROWS)):
        yield _out([*map(list, zip(*own, strict=True))], fields)


def log_frames(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every frame of the logs ``NNNNNN.log`` in a folder: place, checksum, status (ok, torn, bad) and mutation."""
    fields = [("file_num", pa.int64()), ("offset", pa.int64()), ("frame_len", pa.int64()), ("crc", pa.int64()), ("status", pa.string()), *_MUTATION]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for num, data in _opened(batch):
                rows = ((num, f.offset, f.length, f.crc, f.status, *(f.mutation or (None,) * 4)) for f in codec.until_wrong(data))
                yield from _split(rows, fields)

    return _files(spark, path, "log").mapInArrow(parse, f"file_num long, offset long, frame_len long, crc long, status string, {_MUTATION_DDL}")


def logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a log: file_num, size, good bytes, truncated_bytes, and whether it is corrupt."""
    fields = [("file_num", pa.int64()), ("size", pa.int64()), ("good", pa.int64()), ("truncated_bytes", pa.int64()), ("corrupt", pa.bool_())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for num, data in _opened(batch):
                r = codec.replay(data, keep=False)
                yield _out([[num], [len(data)], [r.good], [r.truncated(len(data))], [r.corrupt]], fields)

    return _files(spark, path, "log").mapInArrow(parse, "file_num long, size long, good long, truncated_bytes long, corrupt boolean")


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Mutations of all logs in a folder, up to each log's torn tail; raises :class:`CorruptLog` on bytes that
    are bad before valid frames. Files are left as they are."""
    corrupt = [r.file_num for r in logs(spark, path).where("corrupt").select("file_num").take(1)]
    if corrupt:
        raise CorruptLog(f"log {corrupt[0]:06d} has a bad frame before valid ones")
    return log_frames(spark, path).where("status = 'ok'").select("key", "seq", "op", "value")


def read_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_num and mutations of the sorted tables ``NNNNNN.sst`` in a folder, in file order within each."""
    fields = [("file_num", pa.int64()), *_MUTATION]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for num, data in _opened(batch):
                yield from _split(((num, *m) for m in codec.Table(data).records()), fields)

    return _files(spark, path, "sst").mapInArrow(parse, f"file_num long, {_MUTATION_DDL}")


def table_meta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_num, size, min_key, max_key, num_entries, blocks and filter_bytes of sorted tables, keys from the data."""
    fields = [("file_num", pa.int64()), ("size", pa.int64()), ("min_key", pa.binary()), ("max_key", pa.binary()), ("num_entries", pa.int64()), ("blocks", pa.int64()), ("filter_bytes", pa.int64())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for num, data in _opened(batch):
                table = codec.Table(data)
                keys = [m.key for m in table.records(table.index[-1][1] if table.index else 0)]
                bloom = len(table.bloom.encode()) if table.bloom else 0
                yield _out([[num], [len(data)], [table.index[0][0] if table.index else None], [keys[-1] if keys else None], [table.entries], [len(table.index)], [bloom]], fields)

    return _files(spark, path, "sst").mapInArrow(parse, "file_num long, size long, min_key binary, max_key binary, num_entries long, blocks long, filter_bytes long")


def by_size(mutations: DataFrame, target: int, order: str = "seq") -> DataFrame:
    """``mutations`` with ``file_num`` from 1: ranges of ``order`` of about ``target`` bytes of records each, so
    that a file, which one task writes and one reads, stays that size however many there are."""
    total = mutations.agg(F.coalesce(F.sum(record_size()), F.lit(0))).first()[0]
    return mutations.repartitionByRange(max(1, -(-total // target)), order).withColumn("file_num", (F.spark_partition_id() + 1).cast("long"))


def _grouped(mutations: DataFrame, by: str, order: list[str]) -> DataFrame:
    cast = [F.col(by).cast("long").alias("file_num"), F.col("key").cast("binary").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("byte").alias("op"), F.col("value").cast("binary").alias("value")]
    return mutations.select(*cast).repartition("file_num").sortWithinPartitions("file_num", *order)


def _encoded(grouped: DataFrame, encode: Callable[[Iterable[Mutation]], Iterator[bytes]]) -> DataFrame:
    """(file_num, content): ``encode`` makes the bytes of each run of rows of a file, which come as rows of about
    PIECE bytes, those of a file one after the other in one partition. A piece begins with a record or frame."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for num, own in groupby(rows(batches), lambda row: row[0]):
            held, size = [], 0
            for data in encode(Mutation(*m) for _, *m in own):
                held.append(data)
                size += len(data)
                if size >= PIECE:
                    yield piece(num, b"".join(held))
                    held, size = [], 0
            if held:
                yield piece(num, b"".join(held))

    return grouped.mapInArrow(write, "file_num long, content binary")


def piece(num: int, data: bytes) -> pa.RecordBatch:
    """A row of (file_num, content)."""
    return _out([[num], [data]], [("file_num", pa.int64()), ("content", pa.binary())])


def encode_logs(mutations: DataFrame, by: str = "file_num") -> DataFrame:
    """(file_num, content) of binary logs in pieces, mutations in order of seq."""
    return _encoded(_grouped(mutations, by, ["seq", "key"]), codec.log_pieces)


def encode_tables(mutations: DataFrame, by: str = "file_num", block_size: int = 4096, bits_per_key: int = 10) -> DataFrame:
    """(file_num, content) of sorted tables in pieces; each key once in a file."""
    return _encoded(_grouped(mutations, by, ["key"]), lambda rows: codec.table_pieces(rows, block_size, bits_per_key))


def write_files(encoded: DataFrame, path: str, suffix: str) -> int:
    """Write (file_num, content) as ``NNNNNN.suffix`` files into a folder that pyarrow reaches, given as Spark
    gives it (a path or a URI such as ``file:/x``); returns how many. Rows of a file that follow each other are its pieces.

    Each is written under a temporary name and renamed, so a task that is run again leaves whole files.
    """
    uri = _uri(encoded.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, folder = _store(uri)
        store.create_dir(folder)
        pieces = ((num.as_py(), data.as_buffer()) for batch in batches for num, data in zip(*batch.columns, strict=True))
        for num, own in groupby(pieces, lambda row: row[0]):
            part = f"{folder}/.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(part) as out:
                for _, data in own:
                    out.write(data)
            store.move(part, f"{folder}/{num:06d}.{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

    return encoded.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def table_get(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """file_num, key and whether the filter lets it pass, and what the table has of it (seq, op, value, all null
    if it has nothing), for rows (file_num, key) of ``wanted``: tables that may hold a key by their range.

    A table's keys are probed in its filter first, and only a key that passes is looked for in its block. The
    table comes with its keys to one task; keys beyond KEYS_A_TASK of a table go to several, each with its own copy.
    """
    fields = [("file_num", pa.int64()), ("key", pa.binary()), ("passed", pa.bool_()), *_MUTATION[1:]]
    keys = wanted.select(F.col("file_num").cast("long").alias("file_num"), F.col("key").cast("binary").alias("key"))
    parts = keys.groupBy("file_num").agg(F.ceil(F.count("*") / KEYS_A_TASK).alias("parts"))
    rows = keys.join(parts, "file_num").select("file_num", F.expr("pmod(xxhash64(key), parts)").alias("part"), "key", F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("content"))
    tables = _files(spark, path, "sst").join(parts, "file_num").select("file_num", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("key"), "path", "content")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = None, None
        for batch in batches:
            nums, parts, keys, paths = (c.to_pylist() for c in batch.columns[:4])
            out = []
            for num, part, key, path, content in zip(nums, parts, keys, paths, batch.column(4), strict=True):
                if key is None:
                    own, table = (num, part), codec.Table(content.as_py() if path is None else Pieces(path))
                elif own == (num, part):
                    passed = table.bloom is None or bool(table.bloom.may_contain([key])[0])
                    found = table.get(key) if passed else None
                    out.append((num, key, passed, *(found[1:] if found else (None,) * 3)))
            yield from _split(out, fields)

    dealt = tables.unionByName(rows).repartition("file_num", "part").sortWithinPartitions("file_num", "part", F.col("key").asc_nulls_first())
    return dealt.mapInArrow(look, "file_num long, key binary, passed boolean, seq long, op byte, value binary")


def read_directory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The mutations of a directory of binary files, and its logs as :func:`logs` has them.

    The manifest names the live tables and the logs that are done with; other tables are orphans of writes
    that were cut off. Nothing in the directory is changed.
    """
    files = manifest.Files(spark, path)
    state = manifest.load(files)
    done = set(state["obsolete_wal_nums"] or [])
    tables = [f"{path}/{f['file_num']:06d}.sst" for level in state["levels"] for f in level]
    names = [n for n in files.names() if n.endswith(".log") and n[:-4].isdigit() and int(n[:-4]) not in done]
    found = spark.createDataFrame([], MUTATION)
    if tables:
        found = found.unionByName(read_tables(spark, tables).drop("file_num"))
    if not names:
        return found, spark.createDataFrame([], "file_num long, size long, good long, truncated_bytes long, corrupt boolean")
    paths = [f"{path}/{n}" for n in names]
    return found.unionByName(read_logs(spark, paths)), logs(spark, paths)


def write_directory(mutations: DataFrame, path: str, options: Options | None = None) -> int:
    """Write the newest versions as binary tables of level 1 with their manifest; returns the number of tables.

    Tombstones go, as nothing lies below. Tables are ranges of keys of about ``target_file_size``.
    """
    from tidemark.operators.merge import drop_tombstones, latest

    spark, options = mutations.sparkSession, options or Options()
    rows = drop_tombstones(latest(mutations)).withColumn("size", record_size())
    total, last = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max("seq")).first()
    dealt = rows.repartitionByRange(max(1, -(-total // options.target_file_size)), "key").withColumn("file_num", (F.spark_partition_id() + 1).cast("long"))
    write_files(encode_tables(dealt, block_size=options.block_size, bits_per_key=options.bloom_bits_per_key), path, "sst")
    files = manifest.Files(spark, path)
    made = table_meta(spark, path).collect() if any(n.endswith(".sst") for n in files.names()) else []
    level = [{"file_num": r.file_num, "level": 1, "size": r["size"], "min_key": bytes(r.min_key), "max_key": bytes(r.max_key), "num_entries": r.num_entries} for r in sorted(made, key=lambda r: bytes(r.min_key))]
    state = manifest.empty() | {"next_file_num": max([0, *(f["file_num"] for f in level)]) + 1, "last_seq": last or 0}
    manifest.publish(files, state | {"levels": [[], level] + [[] for _ in range(options.max_levels - 2)]})
    return len(level)
