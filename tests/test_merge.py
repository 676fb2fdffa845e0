"""Newest-wins, lookups and statistics against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import EmptyKey, NotFound
from tidemark.operators import compact, lookup, merge, stats, views
from tidemark.schema import MUTATION, checked

ROWS = "key string, seq long, op int, value string"


def random_rows(seed, n=300, keys=12):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys):02d}", seq, *((2, None) if rng.random() < 0.3 else (1, f"v{seq}"))) for seq in range(n)]


def newest(rows):
    out = {}
    for key, seq, op, value in sorted(rows, key=lambda r: r[1]):
        out[key] = (seq, op, value)
    return out


@pytest.mark.parametrize("resolve", [merge.latest, merge.latest_by_rank, merge.latest_by_join])
def test_latest_equals_dict(spark, resolve):
    rows = random_rows(1)
    random.Random(2).shuffle(rows)
    got = {r.key: (r.seq, r.op, r.value) for r in resolve(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == newest(rows)


def test_older_number_is_ignored_and_tombstone_hides(spark):
    df = spark.createDataFrame([("k", 10, 1, "new"), ("k", 3, 1, "old"), ("d", 1, 1, "x"), ("d", 2, 2, None)], ROWS)
    assert [tuple(r) for r in merge.live(df).collect()] == [("k", 10, "new")]


def test_equal_numbers_have_one_result(spark):
    rows = [("k", 1, 1, "a"), ("k", 1, 1, "b")]
    for order in (rows, rows[::-1]):
        assert merge.latest(spark.createDataFrame(order, ROWS)).first().value == "b"


def test_key_filter_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(random_rows(3), ROWS).write.parquet(path)
    plan = lookup.point_get(spark.read.parquet(path), "k01")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,k01)" in plan


def test_lookups(spark):
    df = spark.createDataFrame(random_rows(4), ROWS)
    state = {k: v for k, (_, op, v) in newest(random_rows(4)).items() if op == 1}
    asked = spark.createDataFrame([(f"k{i:02d}",) for i in range(20)], "key string")
    got = {r.key: (r.found, r.value) for r in lookup.multi_get(df, asked).collect()}
    assert got == {f"k{i:02d}": (f"k{i:02d}" in state, state.get(f"k{i:02d}")) for i in range(20)}
    assert {r.key for r in lookup.missing_keys(df, asked).collect()} == {k for k in got if k not in state}
    assert {r.key for r in lookup.found_keys(df, asked).collect()} == set(state)
    some = next(iter(state))
    assert lookup.get(df, some) == state[some]
    with pytest.raises(NotFound):
        lookup.get(df, "nothing")
    with pytest.raises(EmptyKey):
        lookup.get(df, "")
    assert {r.key for r in lookup.scan(df, "k02", "k05").collect()} == {k for k in state if "k02" <= k < "k05"}
    assert {r.key for r in lookup.scan(df, prefix="k1").collect()} == {k for k in state if k.startswith("k1")}


def test_compaction_keeps_and_drops_tombstones(spark):
    rows = random_rows(5)
    a, b = (spark.createDataFrame(x, ROWS) for x in (rows[:150], rows[150:]))
    assert {r.key for r in compact.compact(a, b).collect()} == set(newest(rows))
    assert {r.key for r in compact.compact(a, b, last_level=True).collect()} == {k for k, v in newest(rows).items() if v[1] == 1}
    whole = merge.live(spark.createDataFrame(rows, ROWS))
    assert compact.differences(whole, merge.live(compact.compact(a, b))).first()[0] == 0


def test_first_hit_by_tier(spark):
    df = spark.createDataFrame([("k", 1, 1, "deep", 2), ("k", 5, 2, None, 1), ("j", 2, 1, "only", 2)], ROWS + ", tier int")
    assert {(r.key, r.tier, r.op) for r in merge.first_hit(df, "tier").collect()} == {("k", 1, 2), ("j", 2, 1)}


def test_rank_and_percentiles(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [(r.rank, r.v) for r in merge.ranked(df, "v").orderBy("rank").collect()] == list(enumerate(sorted(values)))
    got = {r.percent: r.value for r in merge.index_percentiles(df, "v", [50, 99]).collect()}
    assert got == {p: sorted(values)[len(values) * p // 100] for p in (50, 99)}


def test_restart_seek(spark):
    records = spark.createDataFrame([(1, f"k{i:02d}") for i in range(10)], "file_num long, key string")
    restarts = spark.createDataFrame([(1, "k00", 0), (1, "k04", 40), (1, "k08", 80)], "file_num long, key string, offset long")
    assert {r.key: r.offset for r in lookup.restart_seek(records, restarts).collect()} == {f"k{i:02d}": i // 4 * 40 for i in range(10)}


def test_restarts_of_blocks(spark):
    records = spark.createDataFrame([(1, f"k{i}", 30) for i in range(6)], "file_num long, key string, size long")
    got = sorted((r.key, r.offset) for r in lookup.restarts_of(records, 60).collect())
    assert got == [("k0", 0), ("k2", 60), ("k4", 120)]


def test_counters_and_size(spark):
    df = spark.createDataFrame(random_rows(7), ROWS)
    state = newest(random_rows(7))
    r = stats.write_counters(df).first()
    rows = random_rows(7)
    assert (r.puts, r.deletes, r.last_seq, r.live_keys) == (sum(x[2] == 1 for x in rows), sum(x[2] == 2 for x in rows), 299, sum(v[1] == 1 for v in state.values()))
    r = stats.memtable_size(df).first()
    assert (r.memtable_keys, r.memtable_bytes) == (len(state), sum(len(k) + len(v[2] or "") + 48 for k, v in state.items()))


def test_checked_normalises_and_rejects(spark):
    df = spark.createDataFrame([(b"k", 1, 1, None), (b"d", 2, 2, b"x")], MUTATION)
    assert {(bytes(r.key), None if r.value is None else bytes(r.value)) for r in checked(df).collect()} == {(b"k", b""), (b"d", None)}
    with pytest.raises(Exception, match="isn't empty"):
        checked(spark.createDataFrame([(b"", 1, 1, b"v")], MUTATION)).collect()


def test_views_are_mutations(spark):
    events = spark.createDataFrame([(1, 7, "click", "p"), (2, 7, "error", "q")], "event_id long, user_id long, event_type string, props string")
    assert [(r.key, r.seq, r.op, r.value) for r in views.events(events).orderBy("seq").collect()] == [("u-00000007", 1, 1, "p"), ("u-00000007", 2, 2, None)]
    assert [r.tenth for r in views.tiered(views.events(events)).orderBy("seq").collect()] == [3, 6]
    empty = views.tiered(views.events(events.where(F.lit(False))))
    assert empty.count() == 0


def test_bounds_of_padded_keys_reach_the_scan(spark):
    from tidemark.plans import kv

    for name in ("kv_point_get", "kv_range_scan", "kv_prefix_scan"):
        plan = kv.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        pushed = next(x for x in plan.splitlines() if "PushedFilters" in x).split("PushedFilters:")[1]
        assert "user_id" in pushed.split("ReadSchema")[0]
