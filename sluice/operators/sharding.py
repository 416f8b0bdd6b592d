"""Assignment of rows to shards, and planning, doing and checking a change of layout."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.shard_rules import Rule, shard_rule
from sluice.sources import segments


def assign_shards(df: DataFrame, column: str, rule: Rule, name: str = "shard", strict: bool = False) -> DataFrame:
    """Adds the shard of each row; with strict, a row that the rule gives none fails the query."""
    shard = rule(F.col(column))
    if strict:
        shard = F.coalesce(shard, F.raise_error(F.concat(F.lit(f"no shard for {column} "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("int"))
    return df.withColumn(name, shard)


def write_sharded(df: DataFrame, column: str, rule: Rule, path: str) -> None:
    """A folder for each shard. Rows are dealt out by shard and rebalanced by size, so that a hot shard is written by
    several tasks, as several files."""
    assign_shards(df, column, rule, strict=True).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def prune_shards(spark, rule: Rule, dtype: str, values: Iterable | None = None, between: tuple[int, int] | None = None, contiguous: bool = False, n: int = 0) -> list[int]:
    """Shards that a predicate on the raw key can need: of values, or of a range, whose ends bound the shards of a
    contiguous rule; a hashing rule needs all n."""
    wanted = list(values) if values is not None else list(between)
    rows = spark.createDataFrame([(v,) for v in wanted], f"k {dtype}")
    found = sorted({r.shard for r in assign_shards(rows, "k", rule).collect() if r.shard is not None})  # as many as values given
    if between is None:
        return found
    return list(range(found[0], found[-1] + 1)) if contiguous and found else list(range(n))


def scan_shards(spark, path: str, shards: list[int] | None = None) -> DataFrame:
    """All shards, or the folders of some."""
    df = spark.read.parquet(path)
    return df if shards is None else df.where(F.col("shard").isin(shards))


def shard_distribution(df: DataFrame, shard: str = "shard") -> DataFrame:
    counted = df.groupBy(shard).agg(F.count("*").alias("n"))
    return counted.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))  # a row for each shard


def rehash_report(df: DataFrame, column: str, old: Rule, new: Rule) -> DataFrame:
    """The shares of rows that stay and that move."""
    both = df.select((old(F.col(column)) == new(F.col(column))).cast("int").alias("stays"))
    counted = both.agg(F.count("*").alias("n"), F.sum("stays").alias("stay"))
    return counted.select("n", "stay", F.round(F.col("stay") / F.col("n"), 6).alias("stay_ratio"), F.round(1 - F.col("stay") / F.col("n"), 6).alias("move_ratio"))


def migration_plan(df: DataFrame, column: str, old: Rule, new: Rule) -> DataFrame:
    """Rows by source and target shard, the moving ones only."""
    both = df.select(old(F.col(column)).alias("source"), new(F.col(column)).alias("target"))
    return both.where("NOT source <=> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def apply_migration(df: DataFrame, column: str, new: Rule, path: str) -> DataFrame:
    """The table in its new layout, at a new path; the old one stays until the copy is validated."""
    write_sharded(df.drop("shard"), column, new, path)
    return scan_shards(df.sparkSession, path)


def check_migration(old: tuple, new: tuple) -> None:
    """Guards before a migration: layouts (column, name of the rule, its settings...) have the same column and the same
    kind of rule, and differ; a table without a rule is not sharded."""
    if not old or not new or not old[1] or not new[1]:
        raise ValueError("a table without a shard rule has nothing to migrate")
    if old[0].lower() != new[0].lower():
        raise ValueError(f"the shard columns differ: {old[0]} and {new[0]}")
    if old[1] != new[1]:
        raise ValueError(f"the rules differ: {old[1]} and {new[1]}")
    if tuple(old[2:]) == tuple(new[2:]):
        raise ValueError("both layouts are the same; no row needs to move")


def moving_keys(df: DataFrame, column: str, key: str, old: Rule, new: Rule) -> DataFrame:
    """(key, source, target) of each row that a change of the rule moves."""
    both = df.select(key, old(F.col(column)).alias("source"), new(F.col(column)).alias("target"))
    return both.where("NOT source <=> target")


def _strict(column: str, rule: Rule) -> Column:
    return F.coalesce(rule(F.col(column)), F.raise_error(F.concat(F.lit(f"no shard for {column} "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("int"))


def _write_part(rows: DataFrame, path: str) -> list[dict]:
    """Rows with their shard, a folder for each; the manifest's entries of them."""
    spark, name = rows.sparkSession, f"files/{uuid.uuid4().hex}"
    rows.hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{path}/{name}")
    shards = [r.shard for r in spark.read.parquet(f"{path}/{name}").select("shard").distinct().collect()]  # as many as shards
    return [{"shard": s, "path": f"{name}/shard={s}", "mixed": False} for s in sorted(shards)]


def write_layout(df: DataFrame, path: str, layout: tuple) -> int:
    """A sharded table under a manifest, which names the folders of each shard and the layout (column, rule, settings)."""
    column, name, *settings = layout
    parts = _write_part(df.withColumn("shard", _strict(column, shard_rule(name, *settings))), path)
    return segments.commit(df.sparkSession, path, -1, [{"layout": list(layout)}, *parts])


def _read_parts(spark, path: str, parts: list[dict], column: str, rule: Rule) -> DataFrame | None:
    """Rows of folders; of a mixed one, which holds rows that have moved on, those that belong to its shard."""
    out = None
    for mixed in (False, True):
        for shard in sorted({p["shard"] for p in parts if p["mixed"] == mixed}):
            rows = spark.read.parquet(*[f"{path}/{p['path']}" for p in parts if p["shard"] == shard and p["mixed"] == mixed]).withColumn("shard", F.lit(shard))
            rows = rows.where(rule(F.col(column)) == F.lit(shard)) if mixed else rows
            out = rows if out is None else out.unionByName(rows)
    return out


def scan_layout(spark, path: str, shards: list[int] | None = None, version: int | None = None) -> DataFrame | None:
    """A version (the newest by default) of a sharded table, or some of its shards; only their folders are read."""
    head, *parts = segments.live(spark, path, version)[1]
    column, name, *settings = head["layout"]
    return _read_parts(spark, path, [p for p in parts if shards is None or p["shard"] in shards], column, shard_rule(name, *settings))


def migrate(spark, path: str, layout: tuple) -> dict:
    """Changes the layout by writing the moving rows, and no others, to their new shards. The manifest then names the new
    folders beside the old ones; those that lost rows are mixed until clear_moved(). Readers see the old version or the
    new one. Returns the version, the number of rows moved and the shards that lost some."""
    version, (head, *parts) = segments.live(spark, path)
    check_migration(tuple(head["layout"]), tuple(layout))
    if any(p["mixed"] for p in parts):
        raise ValueError("rows that moved before are not cleared yet")
    column, name, *settings = layout
    rule = shard_rule(name, *settings)
    rows = _read_parts(spark, path, parts, column, rule).withColumn("_target", _strict(column, rule))
    moving = rows.where("shard <> _target")
    plan = moving.groupBy("shard", "_target").agg(F.count("*").alias("n")).collect()  # a row for each pair of shards
    lost = sorted({r.shard for r in plan})
    added = _write_part(moving.drop("shard").withColumnRenamed("_target", "shard"), path) if lost else []
    version = segments.commit(spark, path, version, [{"layout": list(layout)}, *({**p, "mixed": p["shard"] in lost} for p in parts), *added])
    return {"version": version, "moved": sum(r.n for r in plan), "lost": lost}


def clear_moved(spark, path: str) -> int:
    """Rewrites the shards that still hold rows which moved on, without those; other folders are not touched."""
    version, (head, *parts) = segments.live(spark, path)
    column, name, *settings = head["layout"]
    mixed = [p for p in parts if p["mixed"]]
    if not mixed:
        return version
    kept = _write_part(_read_parts(spark, path, mixed, column, shard_rule(name, *settings)), path)
    return segments.commit(spark, path, version, [head, *(p for p in parts if not p["mixed"]), *kept])


def validate_migration(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of both, and keys that only one has."""
    lost = before.select(key).exceptAll(after.select(key))
    extra = after.select(key).exceptAll(before.select(key))
    count = lambda d, n: d.agg(F.count("*").alias(n))
    out = count(before, "rows_before").crossJoin(count(after, "rows_after")).crossJoin(count(lost, "lost")).crossJoin(count(extra, "extra"))  # one row each
    return out.withColumn("valid", (F.col("lost") == 0) & (F.col("extra") == 0))


def replica_consistency(replicas: dict[str, DataFrame], op_time: str) -> DataFrame:
    """Rows and last operation of each replica, and whether all agree; a replica without the column is told apart."""
    parts = []
    for name, df in replicas.items():
        there = op_time in df.columns
        last = F.max(F.col(op_time).cast("bigint")) if there else F.lit(None).cast("bigint")
        parts.append(df.agg(F.count("*").alias("n"), last.alias("last_op")).select(F.lit(name).alias("replica"), "n", "last_op", F.lit(there).alias("has_op_time")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    w = Window.partitionBy(F.lit(0))  # a row for each replica
    agree = (F.min("n").over(w) == F.max("n").over(w)) & (F.count("last_op").over(w) == F.count("*").over(w)) & (F.min("last_op").over(w) == F.max("last_op").over(w))
    return out.withColumn("consistent", F.coalesce(agree, F.lit(False)))
