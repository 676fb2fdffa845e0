"""Packing of documents into sequences by minimum bin slack over the histogram of lengths.

A document longer than a sequence is cut into pieces of a whole sequence each, the first of which may
be shorter; nothing else is cut. What decides a packing is only how many pieces have each length, so
the bins are filled from that histogram, which has at most ``capacity`` entries however many documents
there are: per bin the longest piece left is taken, a subset-sum dynamic program over bitsets finds
the fullest feasible combination of the lengths left, and the combination is removed as often as the
counts allow. Pieces then take the places of their length by rank. Ranks come from a count within each
stored partition and a running sum of partition counts, so no length, however common, meets in a task.

Rows: a null or empty text still has its end id and so one piece. Repeated rows are separate
documents. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import steps, stored, texts_only
from .token_ids import CALL_BYTES, word_encoder

#: Up to so many rows of three numbers are broadcast: 15 MB as measured.
SMALL = 100_000


def fill_bins(counts: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how many)]) for every combination, given how many pieces have each length."""
    left, patterns = list(counts), []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            left[longest] -= 1
            rest = _fullest(left, capacity - longest)
            left[longest] += 1
            rest[longest] = rest.get(longest, 0) + 1
            times = min(left[n] // k for n, k in rest.items())
            for n, k in rest.items():
                left[n] -= k * times
            patterns.append((times, sorted(rest.items(), reverse=True)))
    return patterns


def _fullest(left: list[int], space: int) -> dict[int, int]:
    """The multiset of lengths left with the largest sum up to ``space``, long lengths preferred.

    ``reach`` is a bitset of attainable sums; one is kept for each group of equal lengths, so that the
    way back finds how many of each were taken. Short lengths come first: long ones are spent first.
    """
    mask, reach, steps_ = (1 << space + 1) - 1, 1, []
    for n in range(1, space + 1):
        if not left[n]:
            continue
        before, many, size = reach, min(left[n], space // n), 1
        while many:  # multiples in powers of two
            size = min(size, many)
            reach |= reach << n * size & mask
            many -= size
            size *= 2
        steps_.append((n, before))
    total, taken = reach.bit_length() - 1, {}
    for n, before in reversed(steps_):
        k = 0
        most = min(left[n], total // n)
        while not before >> total & 1 or (k < most and before >> total - n & 1):
            total -= n
            k += 1
        if k:
            taken[n] = k
    return taken


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, with_ids: bool = True, plain_specials: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, place (partition and rank in it among its length) and, if asked, ids."""
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "rank": pa.int64()}
    kinds |= {"ids": pa.binary()} if with_ids else {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer, plain_specials)
        end, seen, part = np.array([end_id], encode.dtype).tobytes(), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in steps(batches, "text", CALL_BYTES):
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(ids + end, encode.dtype).astype("<u4")
                first = len(ids) % capacity or capacity
                for i, a in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[a : first if not i else a + capacity]
                    row = (key, i, a, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)]))
                    rows.append((*row, own.astype(encode.dtype).tobytes()) if with_ids else row)
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=[*kinds])

    return texts_only(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, *, with_ids: bool = True, plain_specials: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset: sequences of at most ``capacity`` ids, gapless from 0."""
    spark = docs.sparkSession
    made = stored(pieces(docs, tokenizer, end_id, capacity, with_ids=with_ids, plain_specials=plain_specials), "pieces")
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    if bases.count() <= SMALL:  # else both sides are dealt by part and length
        bases = F.broadcast(bases)
    counts = [0] * (capacity + 1)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row.length] = row.n
    places, sequence, used = [], 0, [0] * (capacity + 1)
    for times, combination in fill_bins(counts, capacity):
        offset = 0
        for n, k in combination:
            places.append((n, used[n], used[n] + k * times, k, sequence, offset))
            used[n] += k * times
            offset += n * k
        sequence += times
    # Every pattern leaves less of some length than it took of it, which can happen about log2(capacity)
    # times a length, and has fewer than 50 lengths: the table is bounded by the capacity alone.
    table = np.array(sorted(places) or [(0, 0, 0, 1, 0, 0)], np.int64)
    keys = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (0, 1))
            at = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            within = rank - at[:, 1]
            new = [pa.array(at[:, 4] + within // at[:, 3]), pa.array(at[:, 5] + within % at[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(2, batch.num_columns)] + new, names=[*batch.schema.names[2:], "sequence_id", "offset"])

    ranked = made.join(bases, ["part", "length"]).select(
        F.col("length").alias("_length"), (F.col("rank") + F.col("base")).alias("_rank"), "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids
    )
    ids = "ids binary, " * with_ids
    return ranked.mapInArrow(place, f"doc_id long, piece int, start long, length long, ids_crc32 long, {ids}sequence_id long, offset long")
