"""Changes of a layout write what moves; tables laid out by one root join without an exchange; a walk reads its own buckets."""

import os

import pytest

from sluice.operators import joins as J
from sluice.operators import sharding as S
from sluice.operators import web as W
from sluice.plans import queries_sql as Q


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def table(spark, path, version=None):
    return sorted((r.k, r.v, r.shard) for r in S.scan_layout(spark, path, version=version).collect())


def test_only_moving_rows_are_written(spark, tmp_path):
    path, n = str(tmp_path), 240
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(n)], "k bigint, v string")
    S.write_layout(rows, path, ("k", "mod", 8))
    old, before = table(spark, path), files(path)
    opened = S.scan_layout(spark, path)
    done = S.migrate(spark, path, ("k", "mod", 12))
    moving = [i for i in range(n) if i % 8 != i % 12]
    assert done == {"version": 1, "moved": len(moving), "lost": list(range(8))}
    written = files(path) - before
    assert spark.read.parquet(*written).count() == len(moving) and before <= files(path)
    want = sorted((i, f"v{i}", i % 12) for i in range(n))
    assert table(spark, path) == want and table(spark, path, 0) == old
    with pytest.raises(ValueError, match="not cleared"):
        S.migrate(spark, path, ("k", "mod", 8))
    assert S.clear_moved(spark, path) == 2 and S.clear_moved(spark, path) == 2
    assert table(spark, path) == want and table(spark, path, 1) == want
    assert sorted((r.k, r.v) for r in opened.collect()) == [x[:2] for x in old]
    assert sorted(r.k for r in S.scan_layout(spark, path, [3, 11]).collect()) == [i for i in range(n) if i % 12 in (3, 11)]


def test_shards_that_keep_their_rows_are_not_touched(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "k bigint, v string")
    ranges = [(0, 24, 0), (25, 49, 1), (50, 74, 2), (75, 99, 3)]
    S.write_layout(rows, path, ("k", "ranges", ranges))
    kept = {f for f in files(path) if "shard=1" not in f}
    assert S.migrate(spark, path, ("k", "ranges", [(0, 24, 0), (25, 39, 1), (40, 49, 4), *ranges[2:]])) == {"version": 1, "moved": 10, "lost": [1]}
    S.clear_moved(spark, path)
    live = {p["path"] for p in S.segments.live(spark, path)[1][1:]}
    assert sum(any(p in f for p in live) for f in kept) == len(kept)
    assert table(spark, path) == sorted((i, f"v{i}", 4 if 40 <= i < 50 else i // 25) for i in range(100))


@pytest.mark.parametrize("new,match", [(("j", "mod", 12), "columns"), (("k", "hash_mod", 12), "rules"), (("k", "mod", 8), "same"), ((), "without"), (("k", None), "without")])
def test_guards(new, match):
    with pytest.raises(ValueError, match=match):
        S.check_migration(("k", "mod", 8), new)


def test_a_key_without_a_shard_stops_the_migration(spark, tmp_path):
    path = str(tmp_path)
    S.write_layout(spark.createDataFrame([(1, "a"), (30, "b")], "k bigint, v string"), path, ("k", "ranges", [(0, 99, 0)]))
    with pytest.raises(Exception, match="no shard"):
        S.migrate(spark, path, ("k", "ranges", [(0, 9, 0)]))
    assert table(spark, path) == [(1, "a", 0), (30, "b", 0)]


def test_family_joins_move_no_rows(spark, sf_dir):
    before = {t.name for t in spark.catalog.listTables()}
    rows = J.family_join(*Q.family(spark, sf_dir), Q.FAMILY)
    out = rows.groupBy("c_custkey").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        assert sum(r["count"] for r in out.collect()) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_step_opens_its_own_buckets(spark):
    """A wide start and a long chain: late steps open one bucket."""
    links = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(200)] + [("t0", "c0"), *((f"c{i}", f"c{i + 1}") for i in range(6)), ("c3", "s1")], "source string, target string")
    seeds = spark.createDataFrame([(f"s{i}",) for i in range(200)], "url string")
    reads = []
    got = {r.url: r.depth for r in W.expand_frontier(seeds, links, 6, buckets=16, reads=reads).collect()}
    assert got == {f"s{i}": 0 for i in range(200)} | {f"t{i}": 1 for i in range(200)} | {f"c{i}": i + 2 for i in range(5)}
    assert reads[0] == 16 and all(x <= 2 for x in reads[1:])
