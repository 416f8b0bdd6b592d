"""Work that grows with the rows, not with rows times the rows beside them, and no Python call a key."""

from pyspark.sql import functions as F

from sluice.operators import logs as L
from sluice.plans.queries_stream import replay
from sluice.streaming import streams


def test_frames_of_trailing_averages_only_grow(spark):
    """A thousand rows of one minute: no frame is summed up anew for each of them."""
    df = spark.range(1000).select("id", F.lit("k").alias("key"), F.timestamp_millis(F.col("id") * 200).alias("ts"), (F.col("id") % 7).cast("double").alias("v"))
    out = L.trailing_averages(df, "key", "ts", "v")
    assert out.columns == ["id", "key", "ts", "v", "avg_1m", "avg_10m", "avg_30m"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("specifiedwindowframe(RangeFrame, unboundedpreceding$()") >= 4 and "specifiedwindowframe(RangeFrame, -" not in plan
    for r in out.collect():
        for m, mean in ((1, r.avg_1m), (10, r.avg_10m)):
            own = [i % 7 for i in range(max(0, r.id - m * 300), r.id + 1)]
            assert abs(mean - sum(own) / len(own)) <= 0.00005001


def test_session_state_is_an_aggregate(spark):
    """No Python call for a key; an older row that comes later changes nothing, of equal times the greater value stays."""
    rows = [(1, "t", "k", 5, "b", 0), (1, "t", "k", 5, "c", 1), (2, "t", "k", 7, "x", 1), (1, "t", "k", 4, "z", 2), (2, "t", "k", 8, "a", 2)]
    df = spark.createDataFrame(rows, "user long, tab string, key string, at int, value string, n int").withColumn("ts", F.timestamp_seconds("at"))
    stream, root = replay(spark, df, "n")
    state = streams.stream_session_state(stream.drop("n", "at"))
    assert "Pandas" not in state._jdf.queryExecution().analyzed().toString()
    with streams.keyed_state(spark):
        streams.store_batches(state, lambda batch, number: batch, f"{root}/state", f"{root}/checkpoint", mode="update").awaitTermination()
    got = spark.read.parquet(f"{root}/state").groupBy("user", "tab", "key").agg(F.max_by("value", "batch").alias("value")).collect()
    assert {(r.user, r.tab, r.key): r.value for r in got} == {(1, "t", "k"): "c", (2, "t", "k"): "a"}


def test_items_of_a_bucket_keep_apart(spark):
    """Large numbers, null ids and times of their own in one bucket; a call of the function serves many items."""
    big = (1 << 53) + 1
    rows = [(big + i, 1, "/a/", f"v{i}", 2, 0, 0) for i in range(40)] + [(None, 1, "/n/", "n", 2, 0, 0), (7, 1, "/late/", None, 3, 0, 0)]
    rows += [(big + i, 1, "/b/", f"w{i}", 2, 60, 1) for i in range(20)] + [(None, None, "/n/", "m", 2, 60, 1), (8, 1, "/x/", "x", 1, 9000, 2), (9, 1, "/y/", "y", 2, 9000, 3)]
    df = spark.createDataFrame(rows, "id bigint, template_id int, path string, value string, total int, at int, n int").withColumn("ts", F.timestamp_seconds(F.col("at") + 10))
    stream, root = replay(spark, df, "n", 4)
    items = streams.gather_items(stream.drop("n", "at"), "30 minutes", buckets=1)
    assert items.schema["id"].dataType.simpleString() == "bigint"
    with streams.keyed_state(spark):
        got = streams.run(items, root).collect()
    want = [(big + i, 1, f"/{p}/", f"{v}{i}", True) for i in range(20) for p, v in (("a", "v"), ("b", "w"))] + [(big + i, 1, "/a/", f"v{i}", False) for i in range(20, 40)]
    want += [(None, 1, "/n/", "n", True), (None, None, "/n/", "m", True), (7, 1, "/late/", None, False), (8, 1, "/x/", "x", True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
