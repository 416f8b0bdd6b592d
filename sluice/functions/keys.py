"""Keys made of columns, and dense or time-ordered ids of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.ordering import running_totals
from sluice.sources.scratch import Scratch


def hash_key(*columns: str, bits: int = 32) -> Column:
    """The MD5 of the columns' texts, folded: its four 32-bit words, or two 64-bit halves, added modulo the width."""
    h = F.md5(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    digits = bits // 4
    parts = [F.conv(F.substring(h, i * digits + 1, digits), 16, 10).cast("decimal(38,0)") for i in range(128 // bits)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    out = total % F.lit(1 << bits).cast("decimal(38,0)")
    if bits == 32:
        return out.cast("bigint")
    return F.when(out >= F.lit(1 << 63).cast("decimal(38,0)"), out - F.lit(1 << 64).cast("decimal(38,0)")).otherwise(out).cast("bigint")


def assign_hash_key(df: DataFrame, columns: list[str], name: str = "hash_key", bits: int = 32) -> DataFrame:
    return df.withColumn(name, hash_key(*columns, bits=bits))


def assign_sequence(df: DataFrame, order: list[str], start: int = 1, name: str = "seq") -> DataFrame:
    """Dense ids in an order, counted partition by partition."""
    out = running_totals(df.withColumn("_one", F.lit(1)), order, ["_one"], Scratch(df.sparkSession, "sequence"))
    return out.withColumn(name, F.col("before__one") + start).drop("_one", "before__one")


def assign_time_ids(df: DataFrame, run_ms: int, order: list[str], epoch_ms: int = 1288834974657, centre: int = 0, name: str = "time_id") -> DataFrame:
    """64-bit ids: milliseconds, 5 bits of centre, 5 of worker, 12 of sequence.

    The rows' dense places in the order stand for time: 4096 ids a worker and millisecond from run_ms on, which is
    given, so that a retried task makes the same ids.
    """
    out = assign_sequence(df, order, 0, "_place")
    place = F.col("_place")
    ms = F.lit(run_ms - epoch_ms) + F.floor(place / F.lit(32 * 4096)).cast("bigint")
    worker = F.floor(place / F.lit(4096)).cast("bigint") % 32
    made = F.shiftleft(ms, 22) + F.lit(centre << 17) + F.shiftleft(worker, 12) + place % 4096
    return out.withColumn(name, made).drop("_place")
