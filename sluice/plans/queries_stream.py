"""Registered queries: streams replayed from files to their end, and compared with what a batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import search as T
from sluice.plans import queries_clean as C
from sluice.plans import queries_logs as L
from sluice.plans.registry import Registry, table
from sluice.sources import segments as V
from sluice.sources.scratch import Scratch, partitions
from sluice.streaming import streams as R

register = Registry()
QUERIES, SQL = register.queries, register.sql


def replay(s, df, order: str, batches: int = 3):
    """The rows as a stream of files, dealt out by range of an order; a batch is as many files as there are partitions,
    each written and read by a task of its own. Files bear the time of their batch, by which a stream takes them."""
    scratch, width = Scratch(s, "stream"), partitions(s)
    root, jvm = scratch.root, s.sparkContext._jvm
    dealt = df.repartitionByRange(batches * width, order).withColumn("_batch", (F.spark_partition_id() / width).cast("int"))
    dealt.write.partitionBy("_batch").parquet(f"{root}/dealt")
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/in")
    fs = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    for i in range(batches):
        folder = jvm.org.apache.hadoop.fs.Path(f"{root}/dealt/_batch={i}")
        found = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet")] if fs.exists(folder) else []
        for k in range(width):
            to = jvm.org.apache.hadoop.fs.Path(f"{root}/in/{i:03d}-{k:05d}.parquet")
            if k < len(found):
                fs.rename(found[k], to)
            else:  # few rows: an empty file keeps the batches apart
                empty = jvm.org.apache.hadoop.fs.Path(f"{root}/empty-{i}-{k}")
                df.limit(0).coalesce(1).write.parquet(str(empty))
                fs.rename(next(f.getPath() for f in fs.listStatus(empty) if f.getPath().getName().endswith(".parquet")), to)
            fs.setTimes(to, 1_700_000_000_000 + 1000 * i, -1)
    return R.read_stream(s, f"{root}/in", width), root


def log(s, d):
    return table(s, d, "events").selectExpr("user_id AS user", "cast(value AS bigint) AS exec_ms", "ts AS end_ts")


@register("r1_stream_index", r"SELECT t AS term, doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents) GROUP BY ALL")
def r1(s, d):
    docs, root = replay(s, table(s, d, "documents").select("doc_id", "text"), "doc_id")
    build = lambda b: T.tokenise_table(b, "doc_id", "text").groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    R.stream_index(docs, build, f"{root}/index", f"{root}/checkpoint").awaitTermination()
    return s.read.parquet(f"{root}/index").drop("batch")


@register("r2_compact_index", r"SELECT t AS term, doc_id, CASE WHEN max(doc_id) % 2 = 0 THEN count(*) ELSE -1 END::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents) GROUP BY t, doc_id")
def r2(s, d):
    tokens = T.tokenise_table(table(s, d, "documents"), "doc_id", "text").groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    root = Scratch(s, "compact").root
    tokens.where("doc_id % 2 = 0").withColumn("batch", (F.col("doc_id") % 4).cast("int")).write.partitionBy("batch").parquet(f"{root}/delta")
    return R.compact_index(s, f"{root}/delta", tokens.withColumn("n", F.lit(-1).cast("bigint")), "doc_id")


@register("r2_versioned_index", SQL["r1_stream_index"])
def r2_versions(s, d):
    """Five batches; segments are merged by twos, and what is read is the newest version."""
    docs, root = replay(s, table(s, d, "documents").select("doc_id", "text"), "doc_id", 5)
    build = lambda b: T.tokenise_table(b, "doc_id", "text").groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    R.stream_versioned_index(docs, build, f"{root}/index", "doc_id", f"{root}/checkpoint", 2).awaitTermination()
    return V.read_index(s, f"{root}/index", "doc_id")


@register("r3_stream_hottest", f"""{L._WITH} SELECT "user", statement, n, least_ms, most_ms, mean_ms, last_ts, total_ms, true AS exact FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, last_ts DESC, total_ms DESC, statement) AS rank FROM (
SELECT "user", statement, count(*)::BIGINT AS n, min(CASE WHEN exec_ms > 0 THEN exec_ms END) AS least_ms, max(exec_ms) AS most_ms, (sum(exec_ms) // count(*))::BIGINT AS mean_ms, max(end_ts) AS last_ts, sum(exec_ms)::BIGINT AS total_ms FROM fp GROUP BY 1, 2)) WHERE rank <= 1024""")
def r3_hottest(s, d):
    rows, root = replay(s, L.log(s, d), "end_ts")
    R.stream_hottest_statements(rows, f"{root}/hottest", f"{root}/checkpoint").awaitTermination()
    return R.hottest_statements(s, f"{root}/hottest")


@register("r3_stream_statement_stats", """SELECT date_trunc('hour', ts) AS start, user_id AS "user", count(*)::BIGINT AS n, max(trunc(value)::BIGINT) AS most_ms, sum(trunc(value)::BIGINT)::BIGINT AS total_ms FROM events
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def r3(s, d):
    rows, root = replay(s, log(s, d), "end_ts")
    return R.run(R.stream_statement_stats(rows), root)


_ENDED = "date_trunc('hour', end_ts) + INTERVAL 1 HOUR <= (SELECT max(end_ts) - INTERVAL 10 MINUTE FROM log)"


@register("r3_stream_statement_load", f"""{L._WITH} SELECT date_trunc('hour', end_ts) AS start, "user", count(*)::BIGINT AS n, count(*) FILTER (sql_type IN ('SELECT', 'SHOW'))::BIGINT AS reads,
count(*) FILTER (sql_type IN ('UPDATE', 'INSERT', 'DELETE', 'REPLACE'))::BIGINT AS writes, sum(net_in)::BIGINT AS net_in, sum(net_out)::BIGINT AS net_out, max(end_ts) AS last_ts,
count(*) FILTER (exec_ms <= 10)::BIGINT AS le_10, count(*) FILTER (exec_ms > 10 AND exec_ms <= 200)::BIGINT AS le_200, count(*) FILTER (exec_ms > 200 AND exec_ms <= 1000)::BIGINT AS le_1000, count(*) FILTER (exec_ms > 1000)::BIGINT AS over_1000,
CASE WHEN hour(start) < 6 OR hour(start) >= 22 THEN '22-06' WHEN hour(start) < 13 THEN '06-13' WHEN hour(start) < 18 THEN '13-18' ELSE '18-22' END AS part FROM log WHERE {_ENDED} GROUP BY 1, 2""")
def r3_load(s, d):
    rows, root = replay(s, L.log(s, d), "end_ts")
    return R.run(R.stream_statement_load(rows), root)


@register("r3_stream_statement_frequency", f"""{L._WITH} SELECT date_trunc('hour', end_ts) AS start, "user", statement, count(*)::BIGINT AS n, min(CASE WHEN exec_ms > 0 THEN exec_ms END) AS least_ms,
max(exec_ms) AS most_ms, sum(exec_ms)::BIGINT AS total_ms, max(end_ts) AS last_ts FROM fp WHERE {_ENDED} GROUP BY 1, 2, 3""")
def r3_frequency(s, d):
    rows, root = replay(s, L.log(s, d), "end_ts")
    return R.run(R.stream_statement_frequency(rows), root)


@register("r4_stream_unseen_ever", "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def r4_ever(s, d):
    rows, root = replay(s, table(s, d, "events").select("user_id", "ts"), "ts")
    R.stream_unseen_ever(rows, "user_id", f"{root}/unseen", f"{root}/checkpoint").awaitTermination()
    return s.read.parquet(f"{root}/unseen").select("user_id")


@register("r4_stream_unseen", "SELECT DISTINCT user_id FROM events")
def r4(s, d):
    rows, root = replay(s, table(s, d, "events").select("user_id", "ts"), "ts")
    return R.run(R.stream_unseen(rows, "user_id", "ts", "3650 days").select("user_id"), root)


@register("r5_stream_clean", "SELECT p_partkey AS id, lower(p_type) AS cleaned, 0::INTEGER AS value_code, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS code FROM part")
def r5(s, d):
    rows, root = replay(s, table(s, d, "part").selectExpr("p_partkey AS id", "'/p_type/' AS path", "p_type AS value", "nullif(p_size % 2, 0) AS odd"), "id")
    return R.run(R.stream_clean(rows, {"/p_type/": [("is_english", "lower")]}, ["odd"]).select("id", "cleaned", "value_code", "code"), root)


@register("r5_stream_clean_items", f"""WITH m AS ({C._MAPPED}), i AS (SELECT id, max(CASE WHEN value = '' AND path = '/size/' THEN 2 WHEN value = '' THEN 1 ELSE 0 END) AS item_code FROM m GROUP BY id),
c AS (SELECT id, path, CASE WHEN path = '/kind/' AND regexp_matches(value, '^[a-zA-Z]+$') THEN lower(value) ELSE value END AS v, (path = '/kind/' AND NOT regexp_matches(value, '^[a-zA-Z]+$'))::INTEGER AS value_code FROM m)
SELECT id, path, trim(regexp_replace(CASE WHEN path = '/kind/' AND v IN ('economy', 'small') THEN 'cheap' ELSE v END, '\\s+', ' ', 'g')) AS value,
greatest(item_code, value_code, (path = '/kind/' AND v NOT IN ('economy', 'small'))::INTEGER, (v = '')::INTEGER)::INTEGER AS code FROM c JOIN i USING (id)""")
def r5_items(s, d):
    """An item's rows come in three batches, by their paths; each is cleaned once all its rows are there."""
    rows = C.melted(s, d).withColumn("template_id", (F.col("id") % 2 + 1).cast("int"))
    rows = rows.withColumn("total", F.lit(4)).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    stream, root = replay(s, rows, "path")
    synonyms = s.createDataFrame([("/kind/", ["economy", "small"], "cheap")], "path string, synonyms array<string>, target string")
    clean = lambda items: R.clean_items(items, C.mapping(s), ["/size/"], {"/kind/": [("is_english", "lower")]}, synonyms)
    R.stream_clean_items(stream, clean, f"{root}/clean", f"{root}/checkpoint").awaitTermination()
    return s.read.parquet(f"{root}/clean").drop("batch")


@register("r6_stream_trailing", """WITH m AS (SELECT event_type, unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE, date_trunc('minute', ts) + INTERVAL 30 MINUTE, INTERVAL 1 MINUTE)) AS "at", value::DECIMAL(24,4) AS v FROM events WHERE value >= 0)
SELECT "at", event_type, round(sum(v)::DOUBLE / count(v), 4) AS mean, count(*)::BIGINT AS n FROM m WHERE "at" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE value >= 0) GROUP BY ALL""")
def r6(s, d):
    rows, root = replay(s, table(s, d, "events").select("event_type", "ts", "value"), "ts")
    return R.run(R.stream_trailing(rows, "event_type", "ts", "value"), root)


def updates(s, d):
    return table(s, d, "events").selectExpr("user_id AS user", "event_type AS tab", "concat('k', event_id % 3) AS key", "ts", "cast(value AS string) AS value")


register("r7_session_state", "SELECT user_id AS \"user\", event_type AS tab, 'k' || event_id % 3 AS key, arg_max(value, ts) AS value FROM events GROUP BY ALL")(
    lambda s, d: R.session_state(updates(s, d)).withColumn("value", F.col("value").cast("double")))


@register("r7_stream_session_state", SQL["r7_session_state"])
def r7_stream(s, d):
    rows, root = replay(s, updates(s, d), "ts")
    with R.keyed_state(s):
        R.store_batches(R.stream_session_state(rows), lambda batch, number: batch, f"{root}/state", f"{root}/checkpoint", mode="update").awaitTermination()
    latest = s.read.parquet(f"{root}/state").groupBy("user", "tab", "key").agg(F.max_by("value", "batch").alias("value"))
    return latest.withColumn("value", F.col("value").cast("double"))
