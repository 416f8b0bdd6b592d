"""Prefix sums and ranks over a whole table, without a window that has one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from sluice.sources.scratch import Scratch, partitions


def running_totals(df: DataFrame, order: list[str], values: list[str], scratch: Scratch) -> DataFrame:
    """Adds before_<value>: the sum of a value over all rows that come earlier in the order.

    The rows are dealt out by range of the order, so that a key's size does not matter; the driver gets one row of
    sums for each partition. `order` must identify a row (equal rows get an arbitrary mutual order).
    """
    spark = df.sparkSession
    ranged = scratch.save(df.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = sorted(tuple(r) for r in ranged.groupBy("_part").agg(*[F.sum(v).cast("bigint").alias(v) for v in values]).collect())
    offsets, total = [], [0] * len(values)
    for part, *own in sums:
        offsets.append((part, *total))
        total = [a + (b or 0) for a, b in zip(total, own, strict=True)]
    starts = spark.createDataFrame(offsets, "_part int, " + ", ".join(f"_start_{v} bigint" for v in values))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).cast("bigint").alias(f"before_{v}") for v in values])
    out = summed.join(F.broadcast(starts), "_part")  # a row for each partition
    return out.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"_start_{v}") for v in values}).drop("_part", *[f"_start_{v}" for v in values])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Adds a row's number, from 1, among the rows of its keys, in an order that identifies a row of a key.

    Rows are dealt out by range of keys and order, so that a hot key fills several partitions; each numbers its own
    rows, and adds how many rows of its first key - the only one that can have begun before - earlier partitions hold.
    """
    spark = df.sparkSession
    ranged = scratch.save(df.repartitionByRange(partitions(spark), *keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    first = ranged.groupBy("_part").agg(F.min(F.struct(*keys)).alias("_k")).select(*[F.col("_k")[k].alias(f"_first_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_first_{k}")) for k in keys]
    spread = ranged.join(F.broadcast(first), same, "left_semi").groupBy("_part", *keys).agg(F.count("*").alias("n")).collect()  # two rows a partition at most
    starts, seen = [], {}
    for part, *key, n in sorted(spread, key=lambda r: r[0]):
        if (before := seen.get(tuple(key), 0)) > 0:
            starts.append((part, *key, before))
        seen[tuple(key)] = before + n
    own = Window.partitionBy("_part", *keys).orderBy(*order)
    numbered = ranged.withColumn("_n", F.row_number().over(own).cast("bigint"))
    if not starts:
        return numbered.withColumn(name, F.col("_n")).drop("_n", "_part")
    fields = ranged.select(*[F.col(k).alias(f"_first_{k}") for k in keys]).schema
    begun = spark.createDataFrame(starts, StructType([StructField("_p", IntegerType()), *[StructField(f.name, f.dataType) for f in fields], StructField("_start", LongType())]))
    out = numbered.join(F.broadcast(begun), [F.col("_part") == F.col("_p"), *same], "left")
    return out.withColumn(name, F.col("_n") + F.coalesce("_start", F.lit(0))).select(*df.columns, name)
