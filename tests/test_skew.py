"""A hot key: results as they were, and its rows in more than one task or file."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice.functions import shard_rules as H
from sluice.operators import logs as L
from sluice.operators import sharding as S
from sluice.operators import web as W
from sluice.operators.ordering import row_numbers
from sluice.sources import tables
from sluice.sources.scratch import Scratch


@pytest.fixture(scope="module")
def hosts(spark):
    """A third of all rows, and more, have one key; some have none."""
    return spark.range(6000).select("id", F.when(F.col("id") % 5 < 3, "hot").when(F.col("id") % 5 == 3, F.concat(F.lit("h"), (F.col("id") % 97).cast("string"))).alias("host"), ((F.col("id") * 7919) % 6007).alias("place"))


def test_row_numbers(spark, hosts):
    out = row_numbers(hosts, ["host"], ["place"], "rn", Scratch(spark, "t")).collect()
    by = {}
    for r in out:
        by.setdefault(r.host, []).append((r.place, r.rn))
    assert len(out) == 6000 and all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
    assert row_numbers(hosts.limit(0), ["host"], ["place"], "rn", Scratch(spark, "t")).count() == 0
    dealt = row_numbers(hosts, ["host"], ["place"], "rn", Scratch(spark, "t"))
    spread = hosts.repartitionByRange(4, "host", "place").withColumn("p", F.spark_partition_id()).where("host = 'hot'").groupBy("p").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 0.6 * dealt.where("host = 'hot'").count()


def test_caps_and_schedules(hosts):
    capped = Counter((r.host, r.deferred) for r in W.cap_per_group(hosts, "host", 40, "place").collect())
    assert capped["hot", False] == 40 and capped["hot", True] == 3560 and capped[None, False] == 40
    times = sorted(r.fetch_at for r in W.politeness_schedule(hosts, "host", "place", 30).where("host = 'hot'").collect())
    assert times == list(range(0, 3600 * 30, 30))


@pytest.fixture
def small_parts(spark):
    """Sizes at which rebalancing parts a shard of this test's size."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_hot_shard_is_several_files(spark, hosts, tmp_path, small_parts):
    rows = hosts.repartition(8).withColumn("k", F.when(F.col("host") == "hot", 0).otherwise(F.col("id"))).withColumn("text", F.sha2(F.col("id").cast("string"), 512))
    S.write_sharded(rows, "k", H.mod(4), f"{tmp_path}/s")
    files = Counter(f.parent.name for f in Path(f"{tmp_path}/s").glob("shard=*/*.parquet"))
    assert files["shard=0"] > 1 and S.scan_shards(spark, f"{tmp_path}/s").count() == 6000
    assert S.scan_shards(spark, f"{tmp_path}/s").where("shard <> k % 4").count() == 0
    tables.write_pages_by_host(rows.fillna("none", ["host"]), f"{tmp_path}/h")
    files = Counter(f.parent.name for f in Path(f"{tmp_path}/h").glob("host=*/*.parquet"))
    assert files["host=hot"] > 1 and spark.read.parquet(f"{tmp_path}/h").count() == 6000


def test_trailing_averages_over_spans(spark):
    rows = [(i, "k" if i % 3 else "l", 37 * i % 90_000, float(i % 11) - 1) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, key string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.avg_1m, r.avg_10m, r.avg_30m) for r in L.trailing_averages(df, "key", "ts", "v").collect()}
    kept = [r for r in rows if r[3] >= 0]
    for i, key, s, _ in kept:
        for m, mean in zip((1, 10, 30), got[i]):
            own = [v for _, k, t, v in kept if k == key and s - 60 * m <= t <= s]
            assert mean == pytest.approx(sum(own) / len(own), abs=1e-4)
    assert len(got) == len(kept)


def test_small_looks_at_bytes(spark):
    from sluice.operators.joins import small

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    wide = spark.range(100).withColumn("x", F.repeat(F.lit("x"), 1000))
    assert hinted(small(wide)) and not hinted(small(wide, rows=99, size=1)) and not hinted(small(wide, size=1000)) and hinted(small(spark.range(10).distinct(), size=200))
