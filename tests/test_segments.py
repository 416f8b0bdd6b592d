"""Versions of an index: a reader between the steps of a merge sees the old or the new version."""

import pytest
from pyspark.sql import functions as F

from sluice.plans.queries_stream import replay
from sluice.sources import segments as V
from sluice.streaming import streams as R


def postings(spark, rows):
    return spark.createDataFrame(rows, "term string, doc_id int, n int")


def read(spark, path, version=None):
    return sorted(tuple(r) for r in V.read_index(spark, path, "doc_id", version=version).select("term", "doc_id", "n").collect())


def test_readers_see_whole_versions(spark, tmp_path):
    path, rest = str(tmp_path), {}
    for i in range(4):
        assert V.add_segment(postings(spark, [("a", 1, i), ("b", i, i)]), path, f"s{i}") == i
        rest[i] = sorted([("a", 1, i), *(("b", k, k) for k in range(i + 1))])
    assert V.add_segment(postings(spark, [("z", 9, 9)]), path, "s2") == 3  # runs twice, counts once
    opened = V.read_index(spark, path, "doc_id")
    seen = []

    def merge(rows):
        seen.append(read(spark, path))  # a reader while the merge is under way
        return V.newest_postings(rows, "doc_id")

    assert V.compact(spark, path, merge, 4) == 4 and seen == [rest[3]]
    assert read(spark, path) == rest[3] and [s["tier"] for s in V.live(spark, path)[1]] == [1]
    assert sorted(tuple(r) for r in opened.select("term", "doc_id", "n").collect()) == rest[3]
    assert {v: read(spark, path, v) for v in range(4)} == rest
    assert V.compact(spark, path, merge, 4) is None
    assert V.add_segment(postings(spark, [("a", 1, 7)]), path, "s1") == 4  # merged away, still known
    with pytest.raises(V.Conflict):
        V.commit(spark, path, 3, [])
    assert read(spark, path) == rest[3]
    assert sorted(V.vacuum(spark, path, 1)) == ["s0", "s1", "s2", "s3"] and read(spark, path) == rest[3]


def test_base_and_nothing(spark, tmp_path):
    path, base = str(tmp_path), postings(spark, [("a", 1, 100), ("c", 3, 100)])
    assert V.read_index(spark, path, "doc_id") is None and V.read_index(spark, path, "doc_id", base) is base
    V.add_segment(postings(spark, [("a", 1, 1)]), path, "x")
    got = V.read_index(spark, path, "doc_id", base).select("term", "doc_id", "n").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 1), ("c", 3, 100)]


def test_batches_pile_up_in_tiers(spark):
    rows = spark.createDataFrame([(i, f"t{i % 3}") for i in range(40)], "doc_id int, term string")
    stream, root = replay(spark, rows, "doc_id", 5)
    R.stream_versioned_index(stream, lambda b: b.withColumn("n", F.lit(1)), f"{root}/i", "doc_id", f"{root}/c", 2).awaitTermination()
    assert [s["tier"] for s in V.live(spark, f"{root}/i")[1]] == [2, 0]
    assert V.read_index(spark, f"{root}/i", "doc_id").count() == 40
