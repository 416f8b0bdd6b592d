import pytest
from pyspark.sql import functions as F

from sluice.functions import shard_rules as H
from sluice.operators import joins as J
from sluice.operators import sharding as S

RANGES = H.parse_ranges("0-200M=0\n200M1-400M=1\n400M1-600M=2\n600M1-800M=3\n800M1-1000M=4")


def shards(spark, rule, values, dtype="bigint"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {dtype}")
    return [r.shard for r in S.assign_shards(rows, "v", rule).orderBy("i").collect()]


def test_ranges(spark):
    assert shards(spark, H.ranges(RANGES), [0, 2000000, 2000001, 4000000, 4000001, 99999999, None]) == [0, 0, 1, 1, 2, None, None]


def test_range_mod(spark):
    groups = [(a, b, n) for (a, b, _), n in zip(RANGES, (5, 1, 4, 4, 6))]
    assert shards(spark, H.range_mod(groups), [0, 1, 2, 3, 4, 5, 2000000, 2000001, 4000000, 4000001]) == [0, 1, 2, 3, 4, 0, 0, 5, 5, 7]


def test_pattern(spark):
    rules = [(1 + 32 * i, 32 * (i + 1), i) for i in range(8)] + [(0, 0, 7)]
    assert shards(spark, H.pattern(256, rules, 2), ["0", "45a"], "string") == [7, 2]


def test_prefix_pattern(spark):
    rules = [(1 + 4 * i, 4 * (i + 1), i) for i in range(8)] + [(0, 0, 7)]
    assert shards(spark, H.prefix_pattern(5, 32, rules), ["gf89f9a", "8df99a", "8dhdf99a"], "string") == [0, 4, 3]


def test_segments_and_slices(spark):
    assert shards(spark, H.segments([2, 1], [256, 512]), [12345]) == [0]
    assert shards(spark, H.string_slice(0, 8, [2, 1], [256, 512]), ["qiushuo"], "string") == [2]
    assert shards(spark, H.string_slice(-4, 0, [2], [512]), ["aaaabbb0000", "aaaabbb2359", "", None], "string") == [0, 0, 0, None]


def test_jump_hash(spark):
    expected = [1, 2, 1, 0, 0, 2, 1, 1, 1, 0, 2, 1, 1, 2, 1, 0, 0, 2, 1, 0, 0, 0, 2, 1]
    assert shards(spark, H.jump_hash(3), [str(i) for i in range(1, 25)], "string") == expected


def test_days_and_months(spark):
    assert shards(spark, H.by_day("2014-01-01", 10), ["2014-01-01", "2014-01-10", "2014-01-11", "2014-05-01", "2013-12-28"], "string") == [0, 0, 1, 12, 0]
    days = ["2014-02-01", "2014-02-19", "2014-02-20", "2014-03-01", "2014-03-02", "2014-03-11", "2014-03-20"]
    assert shards(spark, H.by_day("2014-01-01", 10, "2014-01-31"), days, "string") == [3, 0, 1, 1, 2, 2, 3]
    assert shards(spark, H.by_month("2014-01-01"), ["2014-12-31", "2015-01-31", "2015-12-31"], "string") == [11, 12, 23]
    assert shards(spark, H.by_month("2015-01-01", "2015-12-01"), ["2013-01-02", "2014-02-01", "2016-06-20", "2016-12-31"], "string") == [0, 1, 5, 11]
    assert shards(spark, H.latest_month(24), ["2015020100", "2015020216", "2015022823"], "string") == [0, 40, 671]
    times = ["2014-01-01 00:00:00", "2014-01-01 00:00:01", "2014-01-04 00:00:00", "2014-01-04 00:00:01"]
    assert shards(spark, H.range_date_hash("2014-01-01", 3, 6, 8), times, "string") == [3, 1, 7, 11]


def test_hash_mod_and_ring_stay_in_range(spark):
    values = [f"v{i}é🙂" for i in range(500)]
    for n in (7, 8):
        assert set(shards(spark, H.hash_mod(n), values, "string")) == set(range(n))
    assert set(shards(spark, H.murmur_ring(5), values, "string")) == set(range(5))


def test_murmur_vectors():
    """Published vectors of the 32-bit x86 form, their bytes read as UTF-16 code units. Fixed values."""
    vectors = [("", 0, 0), ("", 1, 0x514E28B7), ("", 0xFFFFFFFF, 0x81F16F39), ("\uffff\uffff", 0, 0x76293B50), ("\u4321\u8765", 0, 0xF55B516B), ("\u4321\u8765", 0x5082EDEE, 0x2362F9DE), ("\u4321", 0, 0xA0F7B07A), ("\0\0", 0, 0x2362F9DE), ("\0", 0, 0x30F4C306)]
    for text, seed, want in vectors:
        assert H.murmur3(text, seed) & 0xFFFFFFFF == want
    texts = ["", "a", "ab", "abc", "ab", "é🙂", "x" * 41]
    assert H.murmur3_all(texts, 7).tolist() == [H.murmur3(t, 7) for t in texts]


def test_ring_takes_the_next_place(spark):
    places, owners = H.murmur_points(3, vnodes=4)
    values = [f"v{i}" for i in range(50)]
    want = []
    for v in values:
        later = [s for p, s in zip(places, owners) if p >= H.murmur3(v, 0)]
        want.append(int(later[0] if later else owners[0]))
    assert shards(spark, H.murmur_ring(3, vnodes=4), values, "string") == want


def test_java_hash_counts_utf16_units(spark):
    row = spark.createDataFrame([("offer", "🙂")], "a string, b string").select(H.java_hash(F.col("a")), H.java_hash(F.col("b"))).first()
    assert row[0] == 105650780 and row[1] == 0xD83D * 31 + 0xDE42


def test_strict_and_registered_rules(spark):
    with pytest.raises(Exception, match="no shard"):
        S.assign_shards(spark.createDataFrame([(5,)], "v int"), "v", H.ranges([(0, 1, 0)]), strict=True).collect()
    H.register_shard_rule("parity", lambda: lambda c: (c % 2).cast("int"))
    assert shards(spark, H.shard_rule("parity"), [4, 7]) == [0, 1]


def test_prune_reads_wanted_folders_only(spark, tmp_path):
    S.write_sharded(spark.range(100), "id", H.mod(8), f"{tmp_path}/t")
    wanted = S.prune_shards(spark, H.mod(8), "bigint", values=[3, 11])
    plan = S.scan_shards(spark, f"{tmp_path}/t", wanted)._jdf.queryExecution().executedPlan().toString()
    assert wanted == [3] and "PartitionFilters: [isnotnull(shard" in plan or "shard" in plan.split("PartitionFilters")[1][:80]
    assert S.prune_shards(spark, H.ranges([(0, 9, 0), (10, 19, 1), (20, 29, 2)]), "int", between=(5, 25), contiguous=True) == [0, 1, 2]


def test_colocated_join_has_no_exchange(spark, sf_dir):
    orders = J.write_bucketed(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "t_orders", "o_orderkey", 4)
    lines = J.write_bucketed(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey"), "t_lines", "l_orderkey", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.colocated_join(orders, lines, "o_orderkey", "l_orderkey")
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE t_orders")
        spark.sql("DROP TABLE t_lines")
