"""A store of versioned keys on Parquet: log batches, sorted files in levels, and a manifest of snapshots.

``log/NNNNNN`` holds batches of mutations as they came, ``data/NNNNNN`` the sorted files of flushes and
compactions. A snapshot is the manifest's list of both; readers keep the list they have read, and files
they may still use go only with :meth:`Store.vacuum`. One writer at a time; a second one fails when it
publishes.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import Closed, EmptyKey, NotFound
from tidemark.operators import files as fileops
from tidemark.operators import lookup
from tidemark.operators.compact import compact
from tidemark.operators.merge import latest, live
from tidemark.options import Options
from tidemark.schema import DELETE, MUTATION, PUT
from tidemark.sources import manifest as m


class Store:
    """An open store. Counters of operations start at zero with each opening; the last number persists."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.files = m.Files(spark, self.path)
        self.manifest = m.load(self.files)
        self.manifest["levels"] += [[] for _ in range(max(self.options.max_levels, len(self.manifest["levels"])) - len(self.manifest["levels"]))]
        self.counters = dict.fromkeys(("puts", "gets", "deletes", "flushes", "compactions"), 0)
        self.closed = False
        # A write that was cut off before it was published left a folder with a higher number.
        used = [int(n) for folder in ("log", "data") for n in self.files.names(folder) if n.isdigit()]
        self.manifest["next_file_num"] = max([self.manifest["next_file_num"], *(n + 1 for n in used)])

    # --- snapshots ---

    def _open(self) -> None:
        if self.closed:
            raise Closed(self.path)

    def _publish(self, **changes) -> None:
        self.manifest = m.publish(self.files, self.manifest | changes)

    def _number(self) -> int:
        self.manifest["next_file_num"] += 1
        return self.manifest["next_file_num"] - 1

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(MUTATION).parquet(*paths) if paths else self.spark.createDataFrame([], MUTATION)

    def _paths(self, rows: list[dict]) -> list[str]:
        return [f"{self.path}/data/{f['path']}" for f in rows]

    def _log_paths(self) -> list[str]:
        return [f"{self.path}/log/{n:06d}" for n in self.manifest["log"]]

    def file_rows(self) -> list[dict]:
        return [f for level in self.manifest["levels"] for f in level]

    def files_table(self) -> DataFrame:
        return m.files_table(self.spark, self.manifest)

    def mutations(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions of the snapshot, or those of files that meet the closed range of keys."""
        self._open()
        rows = [f for f in self.file_rows() if (low is None or f["max_key"] >= low) and (high is None or f["min_key"] <= high)]
        every = self._read([*self._paths(rows), *self._log_paths()])
        if low is not None:
            every = every.where(F.col("key") >= F.lit(low))
        return every.where(F.col("key") <= F.lit(high)) if high is not None else every

    def live(self) -> DataFrame:
        """key, seq and value of all live keys."""
        return live(self.mutations())

    # --- writes ---

    def _append(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """Write (key, op, value) as a log batch, numbered on from the last number in the order of its rows."""
        self._open()
        if stream and self.manifest["streams"].get(stream[0], -1) >= stream[1]:
            return 0  # this batch was published before
        guard = F.when(F.octet_length("key") > 0, F.col("key").cast("binary")).otherwise(F.raise_error(F.lit("empty key")))
        value = F.when(F.col("op") == PUT, F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
        staged_at = f"{self.path}/log/.staged-{self._number():06d}"
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        try:
            batch.select(guard.alias("key"), F.col("op").cast("byte").alias("op"), value.alias("value"), F.spark_partition_id().alias("part"), place.alias("place")).write.mode("overwrite").parquet(staged_at)
            staged = self.spark.read.parquet(staged_at)
            by_part = staged.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("op") == PUT).alias("puts"), F.sum(fileops.record_size()).alias("size"))
            counts = {r.part: (r.n, r.puts, r["size"]) for r in by_part.collect()}
            base, starts = self.manifest["last_seq"] + 1, []
            for part, (n, _, _) in sorted(counts.items()):
                starts.append((part, base))
                base += n
            if not starts:
                return 0
            offsets = F.broadcast(self.spark.createDataFrame(starts, "part int, base long"))  # a row a partition
            num = self._number()
            numbered = staged.join(offsets, "part").select("key", (F.col("base") + F.col("place")).alias("seq"), "op", "value")
            numbered.write.parquet(f"{self.path}/log/{num:06d}")
        except Exception as error:
            if "empty key" in str(error):
                raise EmptyKey("a key has at least a byte") from error
            raise
        finally:
            self.files.delete(f"log/{staged_at.rsplit('/', 1)[1]}")
        streams = self.manifest["streams"] | ({stream[0]: stream[1]} if stream else {})
        total, puts, size = (sum(x[i] for x in counts.values()) for i in range(3))
        self._publish(last_seq=base - 1, log=[*self.manifest["log"], num], log_bytes=self.manifest["log_bytes"] + size, streams=streams)
        self.counters["puts"] += puts
        self.counters["deletes"] += total - puts
        return total

    def put(self, rows: DataFrame) -> int:
        """Insert or overwrite (key, value) rows; returns how many. Of equal keys the later row wins."""
        return self._append(rows.select("key", F.lit(PUT).alias("op"), "value"))

    def delete(self, keys: DataFrame) -> int:
        """Delete keys, whether they exist or not; each takes a number."""
        return self._append(keys.select("key", F.lit(DELETE).alias("op"), F.lit(None).cast("binary").alias("value")))

    def append(self, rows: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """Puts and deletes (key, op, value) in one batch, published together or not at all."""
        return self._append(rows.select("key", "op", "value"), stream)

    def import_mutations(self, mutations: DataFrame) -> None:
        """Add mutations that have their numbers already, such as those of binary logs."""
        self._open()
        num = self._number()
        mutations.select(*(F.col(f.name).cast(f.dataType) for f in MUTATION)).write.parquet(f"{self.path}/log/{num:06d}")
        last, size = self._read([f"{self.path}/log/{num:06d}"]).agg(F.max("seq"), F.sum(fileops.record_size())).first()
        self._publish(last_seq=max(self.manifest["last_seq"], last or 0), log=[*self.manifest["log"], num], log_bytes=self.manifest["log_bytes"] + (size or 0))

    # --- reads ---

    def get(self, key: bytes) -> bytes:
        """The value of a key; raises :class:`NotFound`. Only files that may hold the key are read."""
        self._open()
        if not key:
            raise EmptyKey("a key has at least a byte")
        self.counters["gets"] += 1
        rows = live(self.mutations(key, key)).select("value").take(1)
        if not rows:
            raise NotFound(key)
        return bytes(rows[0].value)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """key, found and value of each row of ``keys``."""
        self._open()
        return lookup.multi_get(self.mutations(), keys.select(F.col("key").cast("binary").alias("key")))

    # --- flush and compaction ---

    def _write_level(self, rows: DataFrame, level: int, units: int) -> list[dict]:
        """Write rows as ``units`` files of disjoint key ranges; returns their manifest entries."""
        num = self._number()
        sized = rows.withColumn("size", fileops.record_size())
        # A flush is one file of level 0, in as many parts as its size asks for.
        dealt = sized.repartitionByRange(units, "key") if level else sized.repartitionByRange("key")
        dealt = dealt.sortWithinPartitions("key").withColumn("unit", F.spark_partition_id() if level else F.lit(0))
        bloom = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.fpp#key": f"{0.6185**self.options.bloom_bits_per_key:.6f}"}
        dealt.write.options(**bloom).partitionBy("unit").parquet(f"{self.path}/data/{num:06d}")
        if not self.files.names(f"data/{num:06d}") or all(not n.startswith("unit=") for n in self.files.names(f"data/{num:06d}")):
            return []
        found = self.spark.read.parquet(f"{self.path}/data/{num:06d}")
        meta = found.groupBy("unit").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n"), F.sum("size").alias("size"))
        entries = [
            {"file_num": num if i == 0 else self._number(), "level": level, "size": r["size"], "min_key": bytes(r.min_key), "max_key": bytes(r.max_key), "num_entries": r.n, "path": f"{num:06d}/unit={r.unit}"}
            for i, r in enumerate(sorted(meta.collect(), key=lambda r: bytes(r.min_key)))
        ]
        return entries

    def flush(self) -> bool:
        """Write the log batches' newest versions as one file of level 0; nothing to do is no change."""
        self._open()
        if not self.manifest["log"]:
            return False
        entries = self._write_level(latest(self._read(self._log_paths())), 0, 1)
        levels = [list(x) for x in self.manifest["levels"]]
        levels[0] += entries
        obsolete = self.manifest["log"]
        self._publish(levels=levels, log=[], log_bytes=0, obsolete_wal_nums=[*self.manifest["obsolete_wal_nums"], *obsolete])
        self.counters["flushes"] += 1
        return True

    def flush_if_full(self) -> bool:
        """Flush once the log holds ``memtable_size`` bytes of records; streaming ingest asks after each batch."""
        self._open()
        return self.manifest["log_bytes"] >= self.options.memtable_size and self.flush()

    def compact_once(self, job: tuple[int, list[dict], list[dict]] | None = None) -> bool:
        """Run the most urgent compaction, or the given one; False if there is none."""
        self._open()
        job = job or fileops.pick(self.file_rows(), self.options)
        if job is None:
            return False
        level, inputs, overlaps = job
        out = level + 1
        deeper = any(self.manifest["levels"][k] for k in range(out + 1, len(self.manifest["levels"])))
        last = out >= self.options.max_levels - 1 and not deeper
        units = max(1, math.ceil(sum(f["size"] for f in (*inputs, *overlaps)) / self.options.target_file_size))
        entries = self._write_level(compact(self._read(self._paths([*inputs, *overlaps])), last_level=last), out, units)
        gone = {f["file_num"] for f in (*inputs, *overlaps)}
        levels = [[f for f in x if f["file_num"] not in gone] for x in self.manifest["levels"]]
        levels[out] = sorted([*levels[out], *entries], key=lambda f: f["min_key"])
        self._publish(levels=levels)
        self.counters["compactions"] += 1
        return True

    def compact_all(self) -> int:
        """Flush, then compact until nothing is due and level 0 is empty; returns the number of compactions."""
        self.flush()
        n = 0
        while True:
            job = fileops.pick(self.file_rows(), self.options)
            if job is None and self.manifest["levels"][0]:
                fresh = sorted(self.manifest["levels"][0], key=lambda f: f["min_key"])
                low, high = min(f["min_key"] for f in fresh), max(f["max_key"] for f in fresh)
                job = (0, fresh, [f for f in self.manifest["levels"][1] if f["max_key"] >= low and f["min_key"] <= high])
            if job is None:
                return n
            self.compact_once(job)
            n += 1

    def vacuum(self, older_than: float = 3600.0) -> list[str]:
        """Remove folders that the snapshot doesn't name, and what writes that were cut off have left, if it has
        not changed for some seconds."""
        self._open()
        keep = {f"log/{n:06d}" for n in self.manifest["log"]} | {f"data/{f['path'].split('/')[0]}" for f in self.file_rows()}
        names = [f"{folder}/{name}" for folder in ("log", "data") for name in self.files.names(folder)]
        names += [name for name in self.files.names() if name.endswith(".tmp")]
        gone = []
        for name in names:
            status = self.files.fs.getFileStatus(self.files.path(name))
            if name not in keep and time.time() - status.getModificationTime() / 1000 >= older_than:
                self.files.delete(name)
                gone.append(name)
        left = [n for n in self.manifest["obsolete_wal_nums"] if f"log/{n:06d}" not in gone]
        if left != self.manifest["obsolete_wal_nums"]:
            self._publish(obsolete_wal_nums=left)
        return gone

    # --- state ---

    def stats(self) -> DataFrame:
        """One row: counters since the opening, what the log holds, the last number, files and bytes by level."""
        self._open()
        from tidemark.operators.stats import memtable_size

        levels = self.manifest["levels"]
        own = [("puts", "long"), ("gets", "long"), ("deletes", "long"), ("flushes", "long"), ("compactions", "long")]
        pending = memtable_size(self._read(self._log_paths())).first()
        row = (*(self.counters[k] for k, _ in own), len(self.manifest["log"]), self.manifest["last_seq"], [len(x) for x in levels], [sum(f["size"] for f in x) for x in levels], *pending)
        names = ", ".join(f"{k} {t}" for k, t in own)
        return self.spark.createDataFrame([row], f"{names}, immutable_memtables long, last_seq long, files_per_level array<long>, bytes_per_level array<long>, memtable_keys long, memtable_bytes long")

    def close(self) -> None:
        """Flush what the log holds; closing twice raises :class:`Closed`."""
        self._open()
        self.flush()
        self.closed = True

