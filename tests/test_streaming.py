"""Streams: ingest into a store, and newest versions as state."""

from tidemark.operators.merge import latest
from tidemark.sources.store import Store
from tidemark.streaming import ingest as s

SCHEMA = "key string, seq long, op int, value string"
BATCHES = [[("a", 1, 1, "x"), ("b", 2, 1, "y")], [("a", 5, 1, "z"), ("a", 3, 1, "late")], [("b", 6, 2, None)]]


def source(spark, path):
    for batch in BATCHES:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def expected(spark):
    return {tuple(r) for r in latest(spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)).collect()}


def test_aggregate_state(spark, tmp_path):
    stream = s.latest_aggregate(source(spark, str(tmp_path / "in")))
    stream.writeStream.outputMode("complete").format("memory").queryName("agg").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("agg").collect()} == expected(spark)


def test_custom_state(spark, tmp_path):
    out = {}
    stream = s.latest_stateful(source(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.update({r.key: tuple(r) for r in df.collect()}))
    q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert set(out.values()) == expected(spark)


def test_ingest_into_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    stream = source(spark, str(tmp_path / "in")).selectExpr("key", "op", "value")
    s.ingest(stream, store, str(tmp_path / "c"), once=True, compact_every=2).awaitTermination()
    assert store.manifest["last_seq"] == 5
    assert store.manifest["streams"]["ingest"] == 2
    assert store.live().count() >= 1
