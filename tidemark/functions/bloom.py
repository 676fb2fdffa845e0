"""Bloom filters over binary keys: double hashing with 64-bit FNV-1a, vectorised over keys of a batch."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FNV-1a's parameters, the byte that tells the second hash apart and what replaces a zero.
FNV_OFFSET, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
SECOND, NOT_ZERO = 0x5F, np.uint64(0x9E3779B97F4A7C15)
#: Sizes are kept in 32 bits; more keys than this allows belong in several filters.
MAX_BITS = (1 << 32) - 8


def fnv1a(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of every key. Keys are taken by length, a byte position of all of them at a time."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    first = np.full(len(keys), FNV_OFFSET)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        table = np.frombuffer(b"".join(keys[i] for i in own.tolist()), np.uint8).reshape(len(own), size)
        h = first[own]
        for column in table.T:
            h = (h ^ column.astype(np.uint64)) * FNV_PRIME
        first[own] = h
    second = (first ^ np.uint64(SECOND)) * FNV_PRIME
    return first, np.where(second == 0, NOT_ZERO, second)


class Bloom:
    """A filter of ``m`` bits with ``k`` probes a key; no bits at all means that every key may be there."""

    def __init__(self, m: int, k: int, bits: bytes | bytearray | None = None):
        self.m, self.k = m, k
        self.bits = np.zeros(m // 8, np.uint8) if bits is None else np.frombuffer(bytes(bits), np.uint8).copy()

    @classmethod
    def sized(cls, keys: int, bits_per_key: int = 10) -> Bloom:
        bits_per_key = bits_per_key if bits_per_key >= 1 else 10
        m = -(-max(64, max(1, keys) * bits_per_key) // 8) * 8
        if m > MAX_BITS:
            raise ValueError(f"{keys} keys need more than {MAX_BITS} bits")
        return cls(m, min(30, max(1, math.floor(bits_per_key * math.log(2) + 0.5))))

    def positions(self, keys: list[bytes]) -> np.ndarray:
        """One row of bit positions a key."""
        return self._positions(*fnv1a(keys))

    def _positions(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (first[:, None] + np.arange(self.k, dtype=np.uint64) * second[:, None]) % np.uint64(self.m)

    def add(self, keys: Iterable[bytes]) -> None:
        self.add_hashes(*fnv1a(list(keys)))

    def add_hashes(self, first: np.ndarray, second: np.ndarray) -> None:
        """Add keys by what :func:`fnv1a` gives for them."""
        at = self._positions(first, second).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))

    def may_contain(self, keys: Iterable[bytes]) -> np.ndarray:
        keys = list(keys)
        if not len(self.bits):
            return np.ones(len(keys), bool)
        at = self.positions(keys)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(1)

    def merge(self, other: Bloom) -> Bloom:
        """The filter of both key sets, which must have the same shape."""
        if (self.m, self.k) != (other.m, other.k):
            raise ValueError("filters differ in shape")
        return Bloom(self.m, self.k, (self.bits | other.bits).tobytes())

    def encode(self) -> bytes:
        return struct.pack("<II", self.k, self.m) + self.bits.tobytes()

    @classmethod
    def decode(cls, data: bytes) -> Bloom:
        """A filter from its bytes; what is too short for a header may contain anything."""
        if len(data) < 8:
            return cls(8, 1, b"\xff")
        k, m = struct.unpack_from("<II", data)
        return cls(min(m, 8 * (len(data) - 8)), k or 1, data[8:])


def build(keys: DataFrame, n: int, bits_per_key: int = 10, column: str = "key") -> Bloom:
    """The filter of a key column. Every task fills one of its own, and they are combined in a tree of
    aggregates, so the driver gets the size of one filter."""
    shape = Bloom.sized(n, bits_per_key)
    m, k = shape.m, shape.k

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, used = Bloom(m, k), False
        for batch in batches:
            if batch.num_rows:
                own.add(batch.column(0).to_pylist())
                used = True
        if used:
            words = np.pad(own.bits, (0, -len(own.bits) % 8)).view("<i8")
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["word", "bits"])

    words = keys.select(F.col(column).cast("binary")).mapInArrow(fill, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    table = np.zeros(-(-(m // 8) // 8), np.int64)
    for row in words:
        table[row.word] = row.bits
    return Bloom(m, k, table.tobytes()[: m // 8])


def probe(filter_: bytes):
    """A function from a key column to whether the encoded filter may contain it; pass only filters of a checked size."""

    @F.pandas_udf("boolean")
    def may_contain(keys: pd.Series) -> pd.Series:
        return pd.Series(Bloom.decode(filter_).may_contain(map(bytes, keys)))

    return may_contain
