"""Streams replayed to their end, against SQL and plain Python."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from sluice.plans import catalog
from sluice.plans.queries_stream import replay
from sluice.streaming import streams


@pytest.mark.parametrize("name, tables", [
    ("r3_stream_statement_load", ["events"]), ("r3_stream_statement_frequency", ["events"]), ("r4_stream_unseen_ever", ["events"]),
    ("r5_stream_clean_items", ["part"]), ("r7_stream_session_state", ["events"]),
])
def test_replayed_streams_give_what_sql_gives(spark, sf_dir, name, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(catalog.SQL[name])
    names = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(n) for n in names]
    found = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == names
    assert Counter(tuple(r) for r in found.select(names).collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_urls_seen_in_any_earlier_batch_are_left_out(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), ("a", 5), ("c", 6), ("b", 7), ("b", 8), (None, 9)], "url string, n int")
    stream, root = replay(spark, rows, "n")
    streams.stream_unseen_ever(stream, "url", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{root}/out").collect()) == ["a", "b", "c"]


def test_state_of_unseen_urls_is_keyed(spark):
    """A batch looks up its own keys and reads no earlier batch."""
    rows = spark.createDataFrame([(f"u{(i * 7) % 90}", i) for i in range(300)], "url string, n int")
    stream, root = replay(spark, rows, "n", 5)
    query = streams.stream_unseen_ever(stream, "url", f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{root}/out").collect()) == sorted(f"u{i}" for i in range(90))
    looked = [p.stateOperators[0].customMetrics["rocksdbGetCount"] for p in query.recentProgress if p.numInputRows]
    assert len(looked) == 5 and looked == sorted(looked, reverse=True) and looked[-1] == 60  # one for each row, and one more for each new URL
    assert all(len(p.sources) == 1 for p in query.recentProgress)
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")


def test_items_are_gathered_over_batches(spark):
    """Complete items as soon as they are, others by the timer, null values and repeated rows included."""
    rows = [(1, 7, "/a/", "x", 3, 0), (2, 7, "/a/", None, 2, 0), (3, 7, "/a/", "late", 9, 0), (1, 7, "/b/", "y", 3, 60), (2, 7, "/a/", None, 2, 61), (1, 7, "/c/", "z", 3, 120), (4, 7, "/a/", "w", 1, 4000), (5, 7, "/a/", "v", 2, 8000), (6, 7, "/a/", "u", 2, 8001)]
    df = spark.createDataFrame(rows, "id bigint, template_id int, path string, value string, total int, at int").selectExpr("*", "timestamp_seconds(at + 10) AS ts")
    stream, root = replay(spark, df, "at", 5)
    with streams.keyed_state(spark):
        got = streams.run(streams.gather_items(stream.drop("at"), "30 minutes"), root).collect()
    found = sorted((r.id, r.path, r.value or "", r.complete) for r in got)
    assert found == [(1, "/a/", "x", True), (1, "/b/", "y", True), (1, "/c/", "z", True), (2, "/a/", "", True), (2, "/a/", "", True), (3, "/a/", "late", False), (4, "/a/", "w", True)]


def test_hottest_statements_keep_exact_counts_in_bounded_state(spark):
    """A skewed stream with many more statements than the summary keeps."""
    rng = np.random.default_rng(4)
    which = np.where(rng.random(6000) < 0.7, rng.integers(0, 12, 6000), rng.integers(100, 4000, 6000))
    rows = [(int(i) % 2, f"select t{w}", int(w) % 50, i) for i, w in enumerate(which)]
    log = spark.createDataFrame([(u, sql, ms, i) for u, sql, ms, i in rows], "user int, sql string, exec_ms int, end_ts int")
    stream, root = replay(spark, log, "end_ts", 6)
    streams.stream_hottest_statements(stream, f"{root}/hot", f"{root}/checkpoint", keep=60).awaitTermination()
    for r in spark.read.parquet(f"{root}/hot").groupBy("batch", "user").count().collect():
        assert r["count"] <= 60
    want = Counter((u, sql) for u, sql, _, _ in rows)
    got = streams.hottest_statements(spark, f"{root}/hot", 12).collect()
    assert len(got) == 24 and all(r.n == want[r.user, r.statement] for r in got if r.exact)
    assert {(r.user, r.statement) for r in got if r.exact} == {k for k, n in want.most_common(12)} | {k for k in want if int(k[1][8:]) < 12}
    state = spark.read.parquet(f"{root}/hot").where("batch = 5").collect()
    held = {(r.user, r.statement) for r in state}
    assert all(r.n <= want[r.user, r.statement] <= r.n + r.missed for r in state)
    floor = {r.user: r.floor for r in state}
    assert all(n <= floor[k[0]] for k, n in want.items() if k not in held)
