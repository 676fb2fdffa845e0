"""Token-id files: canonical length-limited Huffman codes from global counts, in independent blocks.

Format. A directory of Parquet part files with one row for each block:

``part`` (place of the file in document order), ``block`` (place in the part), ``start`` (ids of the
part before the block), ``doc_ids`` and ``doc_lens`` (documents in the block, in order), ``n_ids``,
``payload`` (codes, most significant bit first) and ``checkpoints`` (bit offset of every LANE-th id, as
little-endian u32; u64 when a block has more bits). Beside it a ``code`` table has the code length of
every id. A code word has at most MAX_BITS bits, so one table of 2**MAX_BITS entries decodes it, and
all lanes of a block are decoded side by side. A block holds whole documents: the first that brings it
to BLOCK_IDS ids ends it, and any block can be read without the others.

Rows: null texts count as empty; a document without ids except the end id still has its row; repeated
doc_ids stay separate documents, in order of their ids; rows with a null doc_id come first. Ids take two
bytes while they are coded if the vocabulary has up to 65,536 of them, else four.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, folder, map_texts, stored, texts_only
from .token_ids import CALL_BYTES, ended, id_dtype, word_encoder

MAX_BITS, LANE, BLOCK_IDS = 16, 128, 1 << 18


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids have no code of at most {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, merged = [], weights
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weights))
        merged = both[rank]
    take = 2 * len(weights) - 2
    out = np.zeros(len(weights), np.uint8)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        out[:leaves] += 1
        take = 2 * (take - leaves)
    out[:take] += 1
    lengths[order] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words by (length, id), counting upwards."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[np.count_nonzero(lengths == 0) :]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length by the next ``limit`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))[np.count_nonzero(lengths == 0) :]
    spans = np.left_shift(1, limit - lengths[order].astype(np.int64))
    ids, size = np.repeat(order, spans), np.repeat(lengths[order], spans)
    pad = (1 << limit) - len(ids)
    return np.pad(ids, (0, pad)).astype(np.uint32), np.pad(size, (0, pad), constant_values=1).astype(np.uint8)


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and checkpoints of one block."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ids) else 0
    word = codes[ids].astype(np.int64) << (24 - size - (at & 7))
    place, n = at >> 3, (bits + 7) // 8 + 3
    total = sum(np.bincount(place + k, (word >> (16 - 8 * k)) & 255, n) for k in range(3)) if len(ids) else np.zeros(n)
    lanes = at[::LANE].astype("<u4" if bits < 1 << 32 else "<u8")
    return total.astype(np.uint8)[: (bits + 7) // 8].tobytes(), lanes.tobytes()


def decode_block(payload: bytes, checkpoints: bytes, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = MAX_BITS) -> np.ndarray:
    """Ids of one block: every lane starts at its checkpoint, and all take one id a step."""
    lanes = -(-n // LANE)
    if not n:
        return np.zeros(0, np.uint32)
    at = np.frombuffer(checkpoints, "<u4" if len(checkpoints) == 4 * lanes else "<u8").astype(np.int64)
    raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.empty((LANE, lanes), np.uint32)
    ids, size = table
    for step in range(LANE):
        live = lanes if step < n - (lanes - 1) * LANE else lanes - 1
        look = (window[at[:live] >> 3] << (at[:live] & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[step, :live] = ids[look]
        at[:live] += size[look]
    return out.T.reshape(-1)[:n]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, *, plain_specials: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, of ``id_dtype(vocabulary)``, with the end id) of every document."""
    dtype = id_dtype(vocabulary)

    def make():
        encode = word_encoder(tokenizer, plain_specials)

        def work(keys, texts):
            ids = ended(encode, texts, end_id, dtype)
            return {"doc_id": keys, "n_tokens": [len(x) // dtype.itemsize for x in ids], "ids": ids}

        return work

    return map_texts(texts_only(docs), make, "doc_id long, n_tokens long, ids binary", size=CALL_BYTES)


def token_counts(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of every id. Each task sends its own counts, a row an id; the vocabulary bounds the result."""
    dtype = id_dtype(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            # All ids of the batch lie side by side in the column's buffer.
            ids, size = batch.column(0), 8 if pa.types.is_large_binary(batch.column(0).type) else 4
            if not len(ids):
                continue
            ends = np.frombuffer(ids.buffers()[1], f"<i{size}")[ids.offset : ids.offset + len(ids) + 1]
            total += np.bincount(np.frombuffer(ids.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(dtype), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for row in rows:
        counts[row.id] = row.n
    return counts


_BLOCK = "part int, block long, start long, doc_ids array<long>, doc_lens array<long>, n_ids long, payload binary, checkpoints binary"


def write_token_file(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, path: str | None = None, *, plain_specials: bool = False) -> str:
    """Encode ``docs`` and write their ids, below ``vocabulary``, in ascending doc_id order; returns the file's path.

    Without a ``path`` the file goes with the session.

    Two passes over the ids, since the code needs all counts first: the ids are stored once, counted,
    range-partitioned by doc_id and coded.
    """
    spark = docs.sparkSession
    path = path or folder(spark, "tokens")
    encoded = stored(encode_documents(docs, tokenizer, end_id, vocabulary, plain_specials=plain_specials), "ids")
    lengths = code_lengths(token_counts(encoded, vocabulary))
    codes, dtype = canonical_codes(lengths), id_dtype(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, total, held, keys, sizes = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype)
            payload, checkpoints = encode_block(ids, codes, lengths)
            made = [[part], [block], [start], [keys], [sizes], [len(ids)], [payload], [checkpoints]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            for key, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append(ids)
                keys.append(key)
                sizes.append(n)
                total += n
                if total >= BLOCK_IDS:
                    yield close()
                    block, start, total, held, keys, sizes = block + 1, start + total, 0, [], [], []
        if keys:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = encoded.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(write, _BLOCK)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    discard(encoded)
    return path


def read_token_file(spark: SparkSession, path: str, vocabulary: int, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids (u32, little-endian)."""
    lengths = np.zeros(vocabulary, np.uint8)
    for row in spark.read.parquet(f"{path}/code").where("bits > 0").collect():  # bounded by the vocabulary
        lengths[row.id] = row.bits
    table = decode_table(lengths)
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = memoryview(decode_block(row["payload"], row["checkpoints"], row["n_ids"], table).astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(row["doc_lens"])
                begins = ends - row["doc_lens"]
                for i in range(0, len(ends), 1024):
                    a, b = begins[i : i + 1024], ends[i : i + 1024]
                    cut = [ids[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    made = [np.full(len(a), row["part"]), row["doc_ids"][i : i + 1024], a + row["start"], b - a, [*map(zlib.crc32, cut)]]
                    kinds, names = [pa.int32(), *[pa.int64()] * 4], ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        made, kinds, names = [*made, [*map(bytes, cut)]], [*kinds, pa.binary()], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=names)

    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row a file part
    before, base = 0, {}
    for row in sorted(totals, key=lambda r: r.part):
        base[row.part], before = before, before + row.n
    bases = spark.createDataFrame(list(base.items()) or [(0, 0)], "part int, base long")
    docs = blocks.mapInArrow(read, schema)
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

