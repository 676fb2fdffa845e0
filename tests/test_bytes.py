"""Frames, sorted tables and Bloom filters on bytes."""

import struct
import zlib

import numpy as np
import pytest

from tidemark.functions import codec
from tidemark.functions.bloom import Bloom, build, fnv1a, probe
from tidemark.functions.codec import Mutation

LOG = [Mutation(f"k-{i:03d}".encode(), i + 1, 1, f"v-{i:03d}".encode()) for i in range(8)]
DATA = b"".join(map(codec.encode_frame, LOG))
TAILS = {
    "part of a header": b"\x01\x02\x03",
    "part of a record": struct.pack("<II", 0, 64) + b"x" * 10,
    "bad last byte": codec.encode_frame(LOG[0])[:-1] + bytes([codec.encode_frame(LOG[0])[-1] ^ 255]),
    "implausible length": struct.pack("<II", 0, (1 << 26) + 1),
}


@pytest.mark.parametrize("tail", TAILS.values(), ids=TAILS.keys())
def test_torn_tails_are_cut_and_counted(tail):
    found = codec.replay(DATA + tail)
    assert [f.mutation for f in found.frames[:-1]] == LOG
    assert not found.corrupt
    assert found.truncated(len(DATA + tail)) == len(tail)


def test_bad_frame_before_valid_ones_is_corrupt():
    broken = bytearray(DATA)
    broken[20] ^= 1
    found = codec.replay(bytes(broken))
    assert found.corrupt and found.good == 0


def test_frames_are_contiguous_and_checked_independently():
    rows = [*LOG[:3], Mutation(b"k-002", 9, 2, None)]
    data, at = b"".join(map(codec.encode_frame, rows)), 0
    for row in rows:
        crc, n = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + n]
        assert crc == zlib.crc32(data[at + 4 : at + 8] + body)
        assert body[17 : 17 + len(row.key)] == row.key
        at += 8 + n
    assert at == len(data)
    assert [f.mutation for f in codec.replay(data).frames] == rows


def test_oversize_is_refused():
    with pytest.raises(ValueError):
        codec.encode_frame(Mutation(b"k", 1, 1, b"x" * (1 << 26)))


def test_sorted_table_round_trip_and_seek():
    rows = [Mutation(f"r{i:04d}".encode(), i, 1 + (i % 5 == 0), None if i % 5 == 0 else b"v" * (i % 40)) for i in range(300)]
    table = codec.Table(codec.encode_table(rows, block_size=256))
    assert list(table.records()) == rows
    assert len(table.index) > 10 and table.entries == 300
    for row in rows[::7]:
        assert table.get(row.key) == row
    assert table.get(b"r0001x") is None and table.get(b"a") is None and table.get(b"z") is None
    with pytest.raises(ValueError):
        codec.encode_table(rows[::-1])
    with pytest.raises(ValueError):
        codec.Table(b"short")
    assert list(codec.Table(codec.encode_table([])).records()) == []


def test_fnv_matches_its_definition():
    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    keys = [b"", b"a", b"hello", b"k" * 50, b"\xff\x00"]
    first, second = fnv1a(keys)
    assert first.tolist() == [plain(k) for k in keys]
    assert second.tolist() == [plain(k + b"_") for k in keys]


def test_bloom_has_no_false_negatives_and_few_false_positives():
    keys = [f"in-{i}".encode() for i in range(2000)]
    b = Bloom.sized(2000, 10)
    b.add(keys)
    assert b.may_contain(keys).all()
    assert b.may_contain([f"out-{i}".encode() for i in range(10_000)]).mean() <= 0.05
    again = Bloom.decode(b.encode())
    assert (again.m, again.k) == (b.m, b.k) and np.array_equal(again.bits, b.bits)
    assert Bloom.decode(b"abc").may_contain([b"x"]).all()
    assert (Bloom.sized(0, 0).m, Bloom.sized(0, 0).k) == (64, 7)
    with pytest.raises(ValueError):
        Bloom.sized(1 << 30, 10)


def test_bloom_of_a_dataframe(spark):
    keys = spark.range(3000).selectExpr("cast(concat('key-', id) as binary) as key")
    built = build(keys, 3000)
    plain = Bloom.sized(3000)
    plain.add([f"key-{i}".encode() for i in range(3000)])
    assert np.array_equal(built.bits, plain.bits)
    assert keys.where(~probe(built.encode())("key")).count() == 0
