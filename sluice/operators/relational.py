"""Aggregation, HAVING, sorting, slicing and union of tables that may be spread over shards."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_COMPARE = {"=": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "!=": operator.ne}


def exact_sum(column: str, scale: int = 2) -> Column:
    """SUM of a double that holds decimals: added as decimals, so that the order of rows does not show."""
    return F.sum(F.col(column).cast(f"decimal(24,{scale})")).cast("double")


def merge_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def merge_sum(df: DataFrame, keys: list[str], column: str, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(exact_sum(column).alias(name))


def merge_min(df: DataFrame, keys: list[str], column: str, name: str = "least") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(column).alias(name))


def merge_max(df: DataFrame, keys: list[str], column: str, name: str = "most") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(column).alias(name))


def merge_avg(df: DataFrame, keys: list[str], column: str, name: str = "mean", places: int = 4) -> DataFrame:
    """AVG as the quotient of merged SUM and COUNT; nulls count in neither."""
    return df.groupBy(*keys).agg(F.round(exact_sum(column) / F.count(column), places).alias(name))


def group_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """One row for each combination of keys; Spark merges per-task partials, so no shard sends raw rows."""
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def global_aggregate(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    return df.agg(*[a.alias(n) for n, a in aggs.items()])


def having(df: DataFrame, column: str, op: str, literal) -> DataFrame:
    return df.filter(_COMPARE[op](F.col(column), F.lit(literal)))


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def two_phase_aggregate(df: DataFrame, shard: str, keys: list[str], column: str) -> DataFrame:
    """Partials of each shard, then their merge: equal to one aggregate over all rows."""
    exact = F.col(column).cast("decimal(24,2)")
    parts = df.groupBy(shard, *keys).agg(F.sum(exact).alias("s"), F.count(column).alias("c"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    return parts.groupBy(*keys).agg(
        F.sum("s").cast("double").alias("total"), F.sum("c").alias("n"), F.min("lo").alias("least"), F.max("hi").alias("most"),
        F.round(F.sum("s").cast("double") / F.sum("c"), 4).alias("mean"),
    )


def sort_rows(df: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in order])


def slice_rows(df: DataFrame, offset: int, n: int) -> DataFrame:
    """LIMIT offset, n of a sorted table."""
    return df.offset(offset).limit(n)


def cap_rows(df: DataFrame, most: int, limited: bool = False) -> DataFrame:
    """The default cap on rows of a query that has no limit of its own."""
    return df if limited else df.limit(most)


def page_by_row_number(df: DataFrame, order: list[str], low: int, high: int, name: str = "rn") -> DataFrame:
    """Rows low to high of an order. Only the first `high` rows, which Spark's top-k finds task by task, are numbered."""
    first = df.orderBy(*order).limit(high)
    return first.withColumn(name, F.row_number().over(Window.orderBy(*order))).where((F.col(name) >= low) & (F.col(name) <= high))


def union_shards(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def union_queries(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()
