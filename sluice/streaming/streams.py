"""Structured Streaming forms: incremental index, statement statistics, unseen URLs, cleaning, trailing means, state.

Each takes a streaming (or, for the stateless ones, any) DataFrame; run() replays a stream to its end, as tests do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from sluice.operators.cleaning import audit_missing, check_required, clean_values, map_schema, normalise_whitespace, replace_synonyms
from sluice.operators.logs import READS, WRITES, fingerprint
from sluice.operators.search import merge_postings
from sluice.sources.segments import add_segment, compact, newest_postings


def read_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of parquet files as a stream, `files` of them a batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def run(df: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """All that there is of a stream, appended to a table in `out`."""
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/rows")


def store_batches(rows: DataFrame, build, path: str, checkpoint: str, available_now: bool = True, mode: str = "append", again: bool = False):
    """build(batch, number) of every batch, under a folder of its number, so that a batch that runs twice counts once.
    again: it reads the batch more than once; else the stream's own work would run as often."""

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist() if again else batch
        build(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if again:
            batch.unpersist()

    writer = rows.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def stream_index(docs: DataFrame, build, path: str, checkpoint: str, available_now: bool = True):
    """Every batch's postings."""
    return store_batches(docs, lambda batch, number: build(batch), path, checkpoint, available_now)


def compact_index(spark: SparkSession, path: str, base: DataFrame | None, key: str) -> DataFrame:
    """The base with all batches merged in; of a document's posting in several, the newest batch counts."""
    delta = spark.read.parquet(path)
    best = delta.groupBy("term", key).agg(F.max_by(F.struct(*[c for c in delta.columns if c not in ("term", key, "batch")]), "batch").alias("_p"))
    delta = best.select("term", key, "_p.*")
    return delta if base is None else merge_postings([delta, base], key)


def stream_versioned_index(docs: DataFrame, build, path: str, key: str, checkpoint: str, fanout: int = 4, available_now: bool = True):
    """Every batch's postings as a segment of a versioned index, merged tier by tier as they pile up; readers open
    versions (segments.read_index)."""

    def store(batch: DataFrame, number: int) -> None:
        add_segment(build(batch), path, f"batch-{number}")
        while compact(batch.sparkSession, path, lambda rows: newest_postings(rows, key), fanout) is not None:
            pass

    writer = docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def stream_statement_stats(log: DataFrame, ts: str = "end_ts", window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    rows = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    out = rows.groupBy(F.window(ts, window).alias("w"), "user").agg(F.count("*").alias("n"), F.max("exec_ms").alias("most_ms"), F.sum("exec_ms").alias("total_ms"))
    return out.select(F.col("w.start").alias("start"), "user", "n", "most_ms", "total_ms")


def _hourly(log: DataFrame, ts: str, watermark: str) -> DataFrame:
    return log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def stream_statement_load(log: DataFrame, ts: str = "end_ts", zone: str = "UTC", watermark: str = "10 minutes") -> DataFrame:
    """For each hour and user: reads and writes, bytes, latencies, and the part of the day that the hour is in."""
    ms = F.col("exec_ms")
    rows = _hourly(log, ts, watermark).groupBy(F.window(ts, "1 hour").alias("w"), "user").agg(
        F.count("*").alias("n"), F.count_if(F.col("sql_type").isin(*READS)).alias("reads"), F.count_if(F.col("sql_type").isin(*WRITES)).alias("writes"),
        F.sum("net_in").alias("net_in"), F.sum("net_out").alias("net_out"), F.max(ts).alias("last_ts"),
        F.count_if(ms <= 10).alias("le_10"), F.count_if((ms > 10) & (ms <= 200)).alias("le_200"), F.count_if((ms > 200) & (ms <= 1000)).alias("le_1000"), F.count_if(ms > 1000).alias("over_1000"),
    )
    hour = F.hour(F.from_utc_timestamp("start", zone))
    part = F.when((hour < 6) | (hour >= 22), "22-06").when(hour < 13, "06-13").when(hour < 18, "13-18").otherwise("18-22")
    return rows.withColumn("start", F.col("w.start")).drop("w").withColumn("part", part)


def stream_statement_frequency(log: DataFrame, ts: str = "end_ts", watermark: str = "10 minutes") -> DataFrame:
    """For each hour and user: how often each statement ran, and its times."""
    rows = _hourly(log, ts, watermark).withColumn("statement", fingerprint(F.col("sql")))
    out = rows.groupBy(F.window(ts, "1 hour").alias("w"), "user", "statement").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("exec_ms") > 0, F.col("exec_ms"))).alias("least_ms"), F.max("exec_ms").alias("most_ms"), F.sum("exec_ms").alias("total_ms"), F.max(ts).alias("last_ts"),
    )
    return out.withColumn("start", F.col("w.start")).drop("w")


def _statement_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("user", fingerprint(F.col("sql")).alias("statement")).agg(
        F.count("*").alias("n"), F.min(F.when(F.col("exec_ms") > 0, F.col("exec_ms"))).alias("least_ms"), F.max("exec_ms").alias("most_ms"),
        F.sum("exec_ms").alias("total_ms"), F.max("end_ts").alias("last_ts"), F.lit(0).cast("bigint").alias("missed"), F.lit(0).cast("bigint").alias("floor"),
    )


def merge_hottest(had: DataFrame | None, fresh: DataFrame, keep: int) -> DataFrame:
    """Two summaries as one of `keep` statements a user. floor bounds how often any statement ran that the summary lacks;
    a statement that comes anew may have run `missed` times before; where that is 0, its numbers are exact."""
    if had is not None:
        floors = had.groupBy(F.col("user").alias("_user")).agg(F.max("floor").alias("_floor"))
        fresh = fresh.join(floors, F.col("user").eqNullSafe(F.col("_user")), "left").withColumn("_floor", F.coalesce("_floor", F.lit(0))).drop("_user")
        both = had.withColumn("_old", F.lit(True)).withColumn("_floor", F.col("floor")).unionByName(fresh.withColumn("_old", F.lit(False)))
        fresh = both.groupBy("user", "statement").agg(
            F.sum("n").alias("n"), F.min("least_ms").alias("least_ms"), F.max("most_ms").alias("most_ms"), F.sum("total_ms").alias("total_ms"), F.max("last_ts").alias("last_ts"),
            F.coalesce(F.max(F.when(F.col("_old"), F.col("missed"))), F.max("_floor")).alias("missed"), F.max("_floor").alias("floor"),
        )
    most = F.col("n") + F.col("missed")
    hottest = Window.partitionBy("user").orderBy(F.desc(most), F.desc("last_ts"), F.desc("total_ms"), "statement")
    ranked = fresh.withColumn("_rank", F.row_number().over(hottest)).where(F.col("_rank") <= keep + 1)  # cut in each task before rows move
    floor = F.max(F.greatest("floor", F.when(F.col("_rank") > keep, most).otherwise(0))).over(Window.partitionBy("user"))
    return ranked.withColumn("floor", floor).where(F.col("_rank") <= keep).drop("_rank")


def stream_hottest_statements(log: DataFrame, path: str, checkpoint: str, keep: int = 4096, available_now: bool = True):
    """The hottest statements of each user, of all batches so far: a summary of `keep` statements a user, merged with what
    each batch counts. Its size does not grow with the stream; a batch reads the summary before it and nothing older."""
    spark = log.sparkSession

    def merge(batch: DataFrame, number: int) -> DataFrame:
        had = spark.read.parquet(f"{path}/batch={number - 1}") if number else None
        return merge_hottest(had, _statement_counts(batch), keep)

    return store_batches(log, merge, path, checkpoint, available_now)


def hottest_statements(spark: SparkSession, path: str, most: int = 1024) -> DataFrame:
    """Of the newest summary: user, statement, n, least_ms, most_ms, mean_ms, last_ts, total_ms, exact."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    rows = spark.read.parquet(f"{path}/batch={last}")
    order = Window.partitionBy("user").orderBy(F.desc("n"), F.desc("last_ts"), F.desc("total_ms"), "statement")
    rows = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    return rows.select("user", "statement", "n", "least_ms", "most_ms", F.expr("total_ms div n").alias("mean_ms"), "last_ts", "total_ms", (F.col("missed") == 0).alias("exact"))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, on the executors' disks: a batch looks up its own keys."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def first_rows(df: DataFrame, column: str) -> DataFrame:
    """Of each value one row in each batch of a task, so that few of a hot value's rows move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = pc.dictionary_encode(b[column]).indices.to_numpy(zero_copy_only=False)
            yield b.take(pa.array(np.sort(np.unique(codes, return_index=True)[1])))

    return df.mapInArrow(run, df.schema)


def stream_unseen_ever(urls: DataFrame, url: str, path: str, checkpoint: str, available_now: bool = True):
    """Each URL once, whenever it was seen before. The URLs so far are keyed state, of which a batch reads and writes what
    it brings; nothing earlier is read again. Of a URL's rows in one batch any one stays; null is no URL."""
    rows = first_rows(urls.where(F.col(url).isNotNull()), url).dropDuplicates([url])
    with keyed_state(urls.sparkSession):
        return store_batches(rows, lambda batch, number: batch, path, checkpoint, available_now)


def stream_unseen(urls: DataFrame, url: str, ts: str, horizon: str) -> DataFrame:
    """Each URL once within the horizon."""
    return urls.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, horizon).dropDuplicatesWithinWatermark([url])


def stream_clean(rows: DataFrame, rules: dict, columns: list[str]) -> DataFrame:
    """Value rules and the audit of missing fields, row by row."""
    return audit_missing(clean_values(rows, rules).withColumnRenamed("code", "value_code"), columns)


def gather_items(rows: DataFrame, idle: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """(id, template_id, path, value, complete): an item's rows (id, template_id, path, value, total, ts) over all batches,
    together as soon as there are `total` of them; or, by a timer, once event time is `idle` past the last of them, and
    then with complete false. Without a total it waits for the timer. A row that comes
    later begins the item anew, or, `idle` behind all rows' time, is dropped.

    Items are dealt into hash buckets, of which a batch reads and writes those that it brings rows for: a Python call
    serves a bucket's items, not one. What a bucket holds is in one task's memory."""

    def gather(key, batches, state: GroupState):
        now = state.getCurrentWatermarkMs()
        items = {i: (rows, last, due) for i, rows, last, due in json.loads(state.get[0])} if state.exists else {}
        fresh: dict[str | None, tuple[list, int, int]] = {}
        for b in batches:  # one without rows, where a bucket's time is up
            columns = b[["_id", "template_id", "path", "value", "total", "_at"]].astype(object).where(b[["_id", "template_id", "path", "value", "total", "_at"]].notna(), None)
            for i, t, p, v, total, at in columns.itertuples(index=False, name=None):
                if i not in fresh:
                    fresh[i] = [*items.pop(i, ([], 0, 0))[:2], 0]
                item = fresh[i]
                item[0].append([t if t is None else int(t), p, v])
                item[1], item[2] = max(item[1], int(at or 0)), max(item[2], int(total or 0))
        done = [(i, *r, True) for i, (held, _, total) in fresh.items() if total and len(held) >= total for r in held]
        done += [(i, *r, False) for i, (held, _, due) in items.items() if due < now for r in held]
        left = [(i, held, last, due) for i, (held, last, due) in items.items() if due >= now]
        left += [(i, held, last, max(last, now + 1)) for i, (held, last, total) in fresh.items() if not (total and len(held) >= total)]
        if left:
            state.update((json.dumps(left),))
            state.setTimeoutTimestamp(max(min(due for *_, due in left), now + 1))  # the watermark is `idle` behind
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=["_id", "template_id", "path", "value", "complete"])

    kind = rows.schema["id"].dataType.simpleString()
    text, back = (F.hex("id"), F.unhex("_id")) if kind == "binary" else (F.col("id").cast("string"), F.col("_id").cast(kind))  # whole numbers stay whole beside null
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", idle)
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("_bucket"), text.alias("_id"), "template_id", "path", "value", "total", "ts", F.unix_millis("ts").alias("_at"))
    out = rows.groupBy("_bucket").applyInPandasWithState(
        gather, "_id string, template_id int, path string, value string, complete boolean", "held string", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select(back.alias("id"), "template_id", "path", "value", "complete")


def stream_clean_items(rows: DataFrame, clean, path: str, checkpoint: str, idle: str = "10 minutes", available_now: bool = True):
    """clean(items) of items gathered over batches, stored batch by batch."""
    with keyed_state(rows.sparkSession):
        return store_batches(gather_items(rows, idle), lambda batch, number: clean(batch), path, checkpoint, available_now, again=True)


def clean_items(rows: DataFrame, mapping: DataFrame, required: list[str], rules: dict, synonyms: DataFrame) -> DataFrame:
    """(id, path, value, code) of items given as (id, template_id, path, value): paths mapped, required ones looked for,
    values cleaned, synonyms and white space made one, missing ones audited. The code is the worst of all steps', that
    of the item's required paths included. Of a stream, items come whole out of gather_items()."""
    mapped = map_schema(rows, mapping).select("id", "path", "value")
    asked = check_required(mapped, required).select("id", F.col("code").alias("item_code"))
    out = clean_values(mapped, rules).select("id", "path", F.col("cleaned").alias("value"), F.col("code").alias("value_code"))
    out = replace_synonyms(out, synonyms).select("id", "path", F.col("canonical").alias("value"), "value_code", F.col("code").alias("synonym_code"))
    out = audit_missing(normalise_whitespace(out, ["value"]), ["value"])
    return out.join(asked, "id").select("id", "path", "value", F.greatest("item_code", "value_code", "synonym_code", "code").alias("code"))


def stream_trailing(df: DataFrame, key: str, ts: str, value: str, minutes: int = 30, slide: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Means over sliding windows; the value at a window's end is the mean of the minutes before it."""
    rows = df.where(F.col(value) >= 0).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    total = F.sum(F.col(value).cast("decimal(24,4)")).cast("double")
    out = rows.groupBy(F.window(ts, f"{minutes} minutes", slide).alias("w"), key).agg(F.round(total / F.count(value), 4).alias("mean"), F.count("*").alias("n"))
    return out.select(F.col("w.end").alias("at"), key, "mean", "n")


def session_state(updates: DataFrame) -> DataFrame:
    """The latest value of (user, tab, key); of equal times the greater value."""
    return updates.groupBy("user", "tab", "key").agg(F.max(F.struct("ts", "value")).alias("_v")).select("user", "tab", "key", "_v.value")


def stream_session_state(updates: DataFrame) -> DataFrame:
    """The same on a stream, in update mode: a row for each key of a batch, with its latest value so far. The state is an
    aggregate's, one row a key; under keyed_state() it lies on the executors' disks."""
    return session_state(updates)
