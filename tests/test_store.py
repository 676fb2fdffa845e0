"""The store: its own lifecycle, a random sequence of actions against a dict, and cut-off writes."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import Closed, Conflict, CorruptLog, EmptyKey, NotFound
from tidemark.functions import codec
from tidemark.operators import files
from tidemark.options import Options
from tidemark.sources import binary, manifest
from tidemark.sources.store import Store

SMALL = Options(l0_compaction_trigger=2, base_level_size=512, target_file_size=256, max_levels=4)


def rows(spark, pairs):
    return spark.createDataFrame([(k.encode(), v.encode()) for k, v in pairs], "key binary, value binary").coalesce(1)


def keys(spark, names):
    return spark.createDataFrame([(k.encode(),) for k in names], "key binary").coalesce(1)


def test_put_get_delete_reopen(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.put(rows(spark, [("hello", "world"), ("hello", "there")]))
    assert store.get(b"hello") == b"there"
    store.delete(keys(spark, ["hello", "unknown"]))
    with pytest.raises(NotFound):
        store.get(b"hello")
    store.put(rows(spark, [("hello", "again"), ("empty", "")]))
    assert store.get(b"empty") == b""
    with pytest.raises(EmptyKey):
        store.put(rows(spark, [("", "v")]))
    with pytest.raises(EmptyKey):
        store.get(b"")
    again = Store(spark, str(tmp_path))
    assert again.get(b"hello") == b"again"
    stats = again.stats().first()
    assert (stats.puts, stats.gets, stats.last_seq) == (0, 1, 6)
    again.close()
    with pytest.raises(Closed):
        again.close()
    with pytest.raises(Conflict):
        store.put(rows(spark, [("a", "b")]))


def test_flush_compact_and_tombstones(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    assert not store.flush()
    for r in range(3):
        store.put(rows(spark, [(f"r{r}-{i:02d}", f"v-{r}-{i}") for i in range(20)]))
        store.flush()
    assert [len(x) for x in store.manifest["levels"]][0] == 3
    store.compact_all()
    shape = store.stats().first()
    assert shape.files_per_level[0] == 0 and sum(shape.files_per_level) >= 2
    for level in store.manifest["levels"][1:]:
        spans = [(f["min_key"], f["max_key"]) for f in level]
        assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert store.live().count() == 60
    store.delete(keys(spark, ["r0-00"]))
    store.compact_all()
    assert store.live().count() == 59
    with pytest.raises(NotFound):
        store.get(b"r0-00")
    assert {(bytes(r.key), r.found) for r in store.multi_get(keys(spark, ["r0-00", "r1-01"])).collect()} == {(b"r0-00", False), (b"r1-01", True)}


def test_random_actions_match_a_dict(spark, tmp_path):
    rng, model = random.Random(11), {}
    store = Store(spark, str(tmp_path), SMALL)
    for _ in range(14):
        action = rng.choice(["write", "write", "write", "flush", "compact", "reopen"])
        if action == "write":
            batch = [(f"k{rng.randrange(21):02d}", rng.choice([None, "", "x" * rng.randrange(24)])) for _ in range(6)]
            data = [(k.encode(), 1 if v is not None else 2, v.encode() if v is not None else None) for k, v in batch]
            store.append(spark.createDataFrame(data, "key binary, op int, value binary").coalesce(1))
            model.update(batch)
        elif action == "flush":
            store.flush()
        elif action == "compact":
            store.compact_all()
        else:
            store = Store(spark, str(tmp_path), SMALL)
        assert {bytes(r.key).decode(): bytes(r.value).decode() for r in store.live().collect()} == {k: v for k, v in model.items() if v is not None}


def test_a_write_that_was_cut_off_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), SMALL)
    store.put(rows(spark, [("a", "1"), ("b", "2")]))
    monkeypatch.setattr(manifest, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    for cut_off in (lambda: store.put(rows(spark, [("a", "9")])), store.flush):
        with pytest.raises(RuntimeError):
            cut_off()
    monkeypatch.undo()
    again = Store(spark, str(tmp_path), SMALL)
    assert again.get(b"a") == b"1"
    again.put(rows(spark, [("c", "3")]))
    again.flush()
    assert again.live().count() == 3
    gone = again.vacuum(0)
    assert any(x.startswith("log/") for x in gone) and any(x.startswith("data/") for x in gone)
    assert Store(spark, str(tmp_path), SMALL).live().count() == 3


def test_stream_batches_count_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    batch = spark.createDataFrame([(b"k", 1, b"v")], "key binary, op int, value binary")
    assert store.append(batch, stream=("s", 0)) == 1
    assert store.append(batch, stream=("s", 0)) == 0
    assert Store(spark, str(tmp_path)).append(batch, stream=("s", 0)) == 0


def test_import_of_binary_logs_and_tables(spark, tmp_path):
    log = [codec.Mutation(b"a", 1, 1, b"x"), codec.Mutation(b"b", 2, 1, b"y"), codec.Mutation(b"a", 3, 2, None)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/000001.log").write_bytes(b"".join(map(codec.encode_frame, log)) + b"\x01\x02")
    (tmp_path / "in/000002.sst").write_bytes(codec.encode_table([codec.Mutation(b"b", 1, 1, b"old"), codec.Mutation(b"c", 0, 1, b"z")]))
    (tmp_path / "in/notes.txt").write_text("not a log")
    where = str(tmp_path / "in")
    from tidemark.operators.stats import recovery_info

    info = recovery_info(binary.logs(spark, where)).first()
    assert (info.torn_tails, info.truncated_bytes) == (1, 2)
    store = Store(spark, str(tmp_path / "store"))
    store.import_mutations(binary.read_logs(spark, where))
    store.import_mutations(binary.read_tables(spark, where).drop("file_num"))
    assert {bytes(r.key): bytes(r.value) for r in store.live().collect()} == {b"b": b"y", b"c": b"z"}
    assert store.manifest["last_seq"] == 3
    meta = binary.table_meta(spark, where).first()
    assert (bytes(meta.min_key), bytes(meta.max_key), meta.num_entries) == (b"b", b"c", 2)
    broken = bytearray(b"".join(map(codec.encode_frame, log)))
    broken[20] ^= 1
    (tmp_path / "in/000003.log").write_bytes(broken)
    with pytest.raises(CorruptLog):
        binary.read_logs(spark, where)


def test_pick_follows_the_triggers():
    def file(n, level, low, high, size=100):
        return {"file_num": n, "level": level, "size": size, "min_key": low, "max_key": high, "num_entries": 1}

    o = Options(l0_compaction_trigger=2, base_level_size=150, max_levels=4)
    assert files.pick([file(1, 0, b"a", b"c")], o) is None
    level, inputs, overlaps = files.pick([file(1, 0, b"a", b"c"), file(2, 0, b"b", b"d"), file(3, 1, b"d", b"e"), file(4, 1, b"f", b"g")], o)
    assert (level, len(inputs), [f["file_num"] for f in overlaps]) == (0, 2, [3])
    level, inputs, overlaps = files.pick([file(5, 1, b"m", b"n"), file(4, 1, b"a", b"c"), file(6, 2, b"c", b"k")], o)
    assert (level, [f["file_num"] for f in inputs], [f["file_num"] for f in overlaps]) == (1, [4], [6])
    assert files.pick([file(1, 1, b"a", b"b", 150)], o) is None  # at its target, not over it
    assert files.pick([file(1, 3, b"a", b"b", 10**9)], o) is None  # the last level is no source
    assert Options(block_size=0).block_size == 4096 and Options().level_target_size(3) == 1000 << 20
    with pytest.raises(ValueError):
        Options(max_levels=1)


def test_a_level_gives_all_it_is_over_by_at_once(spark, tmp_path):
    own = [{"file_num": i, "level": 1, "size": 100, "min_key": b"%02d" % i, "max_key": b"%02d" % i, "num_entries": 1} for i in range(20)]
    below = [{"file_num": 50, "level": 2, "size": 1, "min_key": b"17", "max_key": b"18", "num_entries": 1}, {"file_num": 51, "level": 2, "size": 1, "min_key": b"19", "max_key": b"20", "num_entries": 1}]
    level, inputs, overlaps = files.pick([*own[::-1], *below], Options(l0_compaction_trigger=2, base_level_size=150, max_levels=4))
    assert (level, [f["file_num"] for f in inputs], [f["file_num"] for f in overlaps]) == (1, list(range(19)), [50])
    for n in (100, 400):
        store = Store(spark, str(tmp_path / str(n)), SMALL)
        for r in range(2):
            store.put(rows(spark, [(f"k{i:03d}", f"v-{r}-{i}") for i in range(r, n)]))
            store.flush()
        assert store.compact_all() <= SMALL.max_levels - 1
        levels = store.manifest["levels"]
        assert sum(map(len, levels)) >= n * 25 // SMALL.target_file_size
        assert all(sum(f["size"] for f in levels[k]) <= SMALL.level_target_size(k) for k in range(SMALL.max_levels - 1))
        for own in levels[1:]:
            assert all(a["max_key"] < b["min_key"] for a, b in zip(own, own[1:], strict=False))
        assert {bytes(r.key).decode(): bytes(r.value).decode() for r in store.live().collect()} == {f"k{i:03d}": f"v-{min(i, 1)}-{i}" for i in range(n)}


def test_candidates_by_level(spark):
    rows_ = [(1, 0, 9, b"a", b"m", 1), (2, 0, 9, b"c", b"z", 1), (3, 1, 9, b"a", b"f", 1), (4, 1, 9, b"h", b"k", 1)]
    table = spark.createDataFrame(rows_, "file_num long, level int, size long, min_key binary, max_key binary, num_entries long")
    asked = spark.createDataFrame([(b"d",), (b"g",), (b"zz",)], "key binary")
    got = {(bytes(r.key), r.level, r.file_num) for r in files.candidates(asked, table).collect()}
    assert got == {(b"d", 0, 1), (b"d", 0, 2), (b"d", 1, 3), (b"g", 0, 1), (b"g", 0, 2)}


def test_directory_of_binary_files_round_trips(spark, tmp_path):
    data = [(f"k{i:03d}".encode(), i + 1, 1 + (i % 7 == 0), None if i % 7 == 0 else b"v" * (i % 30)) for i in range(200)]
    df = spark.createDataFrame(data, "key binary, seq long, op int, value binary")
    path = str(tmp_path / "dir")
    n = binary.write_directory(df, path, Options(target_file_size=1024, block_size=128))
    assert n > 3
    (tmp_path / "dir/000900.sst").write_bytes(codec.encode_table([codec.Mutation(b"orphan", 1, 1, b"x")]))
    (tmp_path / "dir/000901.log").write_bytes(codec.encode_frame(codec.Mutation(b"k001", 999, 2, None)) + b"\x01")
    found, logs = binary.read_directory(spark, path)
    store = Store(spark, str(tmp_path / "store"))
    store.import_mutations(found)
    want = {k: v for k, _, op, v in data if op == 1 and k != b"k001"}
    assert {bytes(r.key): bytes(r.value) for r in store.live().collect()} == want
    assert [r.truncated_bytes for r in logs.collect()] == [1]
    empty, none = binary.read_directory(spark, str(tmp_path / "nothing"))
    assert empty.count() == none.count() == 0


def test_a_full_log_is_flushed(spark, tmp_path):
    store = Store(spark, str(tmp_path), Options(memtable_size=100))
    store.put(rows(spark, [("a", "x" * 20)]))
    assert not store.flush_if_full() and store.manifest["log_bytes"] == 38
    store.put(rows(spark, [("b", "x" * 80)]))
    assert store.flush_if_full() and store.manifest["log_bytes"] == 0
    assert not store.flush_if_full()
    assert store.live().count() == 2


def test_of_two_writers_one_gets_the_next_version(spark, tmp_path):
    files = manifest.Files(spark, str(tmp_path / "claims"))
    first = manifest.publish(files, manifest.empty())
    late = dict(first)
    second = manifest.publish(files, first | {"last_seq": 5})
    with pytest.raises(Conflict):
        manifest.publish(files, late)
    # Another writer has claimed the version but not replaced the manifest: its claim counts.
    assert files.replace("MANIFEST-00000003", files.read("MANIFEST").replace(b'"version": 2', b'"version": 3'), over=False)
    assert not files.replace("MANIFEST-00000003", b"{}", over=False)
    with pytest.raises(Conflict):
        manifest.publish(files, second)
    third = manifest.load(files)
    assert (third["version"], third["last_seq"]) == (3, 5)
    assert manifest.publish(files, third)["version"] == 4


def test_vacuum_removes_what_cut_off_writes_left(spark, tmp_path):
    store = Store(spark, str(tmp_path / "cut"))
    store.put(spark.createDataFrame([(b"k", b"v")], "key binary, value binary"))
    for name in ("log/.staged-000099", "data/000098"):
        (tmp_path / "cut" / name).mkdir(parents=True)
    (tmp_path / "cut" / ".MANIFEST-x.tmp").write_bytes(b"{")
    assert sorted(store.vacuum(0)) == [".MANIFEST-x.tmp", "data/000098", "log/.staged-000099"]
    assert store.get(b"k") == b"v"


def test_tables_are_read_by_range_filter_and_block(spark, tmp_path):
    rows = [(n, f"k{n}{i:03d}".encode(), i, 1, b"v") for n in (1, 2) for i in range(0, 200, 2)]
    placed = spark.createDataFrame(rows, "file_num long, key binary, seq long, op int, value binary")
    for path in (str(tmp_path / "plain"), f"file:{tmp_path}/one", f"file://{tmp_path}/three"):
        binary.write_files(binary.encode_tables(placed, block_size=64), path, "sst")
        asked = [(n, f"k{n}{i:03d}".encode()) for n in (1, 2) for i in range(200)]
        got = binary.table_get(spark, path, spark.createDataFrame(asked, "file_num long, key binary")).collect()
        assert {(r.file_num, bytes(r.key)) for r in got} == set(asked) and len(got) == len(asked)
        assert all((r.seq is not None) == (int(r.key[2:]) % 2 == 0) and (r.passed or r.seq is None) for r in got)
        assert sum(r.passed for r in got) < 250  # most absent keys stop at the filter
    binary_keys, binary.KEYS_A_TASK = binary.KEYS_A_TASK, 7
    try:
        split = binary.table_get(spark, path, spark.createDataFrame(asked, "file_num long, key binary")).collect()
    finally:
        binary.KEYS_A_TASK = binary_keys
    assert sorted(map(str, split)) == sorted(map(str, got))


def test_files_of_any_size_go_in_pieces(spark, tmp_path, monkeypatch):
    """As many bytes are held of a large file as of a small one; the results are those of files read whole."""
    rows_ = spark.createDataFrame([(n, f"k{i:05d}".encode(), i, 1 + (i % 9 == 0), b"v" * (i % 50)) for n in (1, 2) for i in range(3000)], "file_num long, key binary, seq long, op int, value binary")
    want = sorted((bytes(r.key), r.seq, r.op, r.value and bytes(r.value)) for r in rows_.withColumn("value", F.when(F.col("op") == 1, F.col("value"))).drop("file_num").collect())
    monkeypatch.setattr(binary, "PIECE", 1000)
    path = str(tmp_path / "small pieces")
    for encode, suffix in ((binary.encode_logs, "log"), (binary.encode_tables, "sst")):
        longest, pieces = encode(rows_).agg(F.max(F.octet_length("content")), F.count("*")).first()
        assert pieces > 200 and longest < 8000  # the filter of a table is its longest piece
        assert binary.write_files(encode(rows_), path, suffix) == 2
    values = [codec.Mutation(bytes(r.key), r.seq, r.op, r.value and bytes(r.value)) for r in rows_.where("file_num = 1").orderBy("seq").collect()]
    assert (tmp_path / "small pieces/000001.log").read_bytes() == b"".join(map(codec.encode_frame, values))
    assert (tmp_path / "small pieces/000001.sst").read_bytes() == codec.encode_table(values)
    with (tmp_path / "small pieces/000002.log").open("ab") as log:
        log.write(b"\x01\x02")
    asked = spark.createDataFrame([(1, b"k00007"), (2, b"k02999"), (2, b"nothing")], "file_num long, key binary")
    for limit in (1 << 30, 1000):
        monkeypatch.setattr(binary, "WHOLE", limit)
        assert [r.content is None for r in binary._files(spark, path, "log").collect()] == [limit == 1000] * 2
        for found in (binary.read_logs(spark, path), binary.read_tables(spark, path).drop("file_num")):
            assert sorted((bytes(r.key), r.seq, r.op, None if r.op == 2 else bytes(r.value or b"")) for r in found.collect()) == [(k, s, o, None if o == 2 else v or b"") for k, s, o, v in want]
        assert sorted(r.truncated_bytes for r in binary.logs(spark, path).collect()) == [0, 2]
        assert sorted((r.num_entries, bytes(r.max_key)) for r in binary.table_meta(spark, path).collect()) == [(3000, b"k02999")] * 2
        assert sorted((r.file_num, r.seq) for r in binary.table_get(spark, path, asked).where("seq is not null").collect()) == [(1, 7), (2, 2999)]


def test_files_are_cut_by_bytes(spark):
    rows = spark.createDataFrame([(f"k{i:04d}".encode(), i, 1, b"x" * 100) for i in range(1000)], "key binary, seq long, op int, value binary")
    sizes = [r["count"] for r in binary.by_size(rows, 12_200).groupBy("file_num").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200 and sum(sizes) == 1000
