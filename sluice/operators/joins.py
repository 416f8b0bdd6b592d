"""Joins of sharded, replicated and co-located tables, lookups and reconciliation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast on request only if it has no more rows and bytes than this; else the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint, if it is small: by the plan's own statistics, or, where they cannot tell, by a
    count of rows and bytes that stops after `rows` rows, so that a large table is not read through."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= size:
        return F.broadcast(df)
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return F.broadcast(df) if found.n <= rows and (found.bytes or 0) <= size else df


def cross_shard_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Left columns, then right columns but the right key. A true outer join where `how` is left."""
    out = left.join(right, left[left_key] == right[right_key], how)
    return out.select(*[left[c] for c in left.columns], *[right[c] for c in right.columns if c != right_key])


def semi_join_keys(fact: DataFrame, keys: DataFrame, fact_key: str, key: str) -> DataFrame:
    return fact.join(keys.select(F.col(key).alias(fact_key)), fact_key, "left_semi")


def replicated_join(fact: DataFrame, dimension: DataFrame, fact_key: str, key: str) -> DataFrame:
    """A dimension that every executor holds, so that the fact table stays where it is."""
    return fact.join(small(dimension), fact[fact_key] == dimension[key]).drop(dimension[key])


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """A table laid out by hash of a key, in `path` (else the warehouse); tables with equal buckets join on it without
    moving rows."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def colocated_join(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Child rows beside their parents: without an exchange where both sides are bucketed alike on the key."""
    return parent.join(child, parent[parent_key] == child[child_key])


def write_family(root: DataFrame, child: DataFrame, grandchild: DataFrame, keys: tuple[str, str, str, str], buckets: int, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables laid out once by their root's key, in equal buckets, so that joins along the family move no rows.
    keys: the root's key, the child's reference to it, the child's own key, the grandchild's reference to that. The
    grandchild gets the root's key as a column `family`. Names in the catalog are dropped; the layout is the files'."""
    root_key, to_root, own, to_own = keys
    third = grandchild.join(child.select(F.col(own).alias(to_own), F.col(to_root).alias("family")), to_own)
    out = []
    for i, (df, key) in enumerate(((root, root_key), (child, to_root), (third, "family"))):
        name = f"family_{uuid.uuid4().hex}"
        out.append(write_bucketed(df, name, key, buckets, f"{path}/{i}"))
        out[-1].schema  # resolved with its buckets; the name is not needed any more
        df.sparkSession.sql(f"DROP TABLE {name}")
    return tuple(out)


def family_join(root: DataFrame, child: DataFrame, grandchild: DataFrame, keys: tuple[str, str, str, str]) -> DataFrame:
    """Rows of all three tables of write_family() together: no exchange. The second join is on the root's key and the
    child's; equal buckets of the first of them are enough, which this session setting allows."""
    root_key, to_root, own, to_own = keys
    root.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    both = root.join(child, root[root_key] == child[to_root])
    return both.join(grandchild, (both[to_root] == grandchild["family"]) & (both[own] == grandchild[to_own])).drop("family")


def inherit_shard(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, shard: str = "shard") -> DataFrame:
    """Each child row with its parent's shard; null where there is no parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key), shard), child_key, "left")


def lookup(df: DataFrame, dictionary: DataFrame, on: str, value: str, name: str) -> DataFrame:
    """The dictionary's value of a key, or the key itself where the dictionary lacks it."""
    found = df.join(small(dictionary.select(on, value)), on, "left")
    return found.withColumn(name, F.coalesce(F.col(value), F.col(on))).drop(*([value] if value != name else []))


def qa_documents(docs: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(queries, key)


def attach_entity(groups: DataFrame, items: DataFrame, key: str) -> DataFrame:
    return groups.join(items, key, "left")


def fingerprint(*columns: str) -> Column:
    return F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def reconcile_entities(snapshot: DataFrame, known: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Each snapshot row matched by the first of `keys` that a known row shares (null never matches), and the action:
    insert, update (an attribute changed) or same. known has known_id, the keys and the attributes; keys are unique."""
    out = snapshot
    for i, key in enumerate(keys):
        side = known.where(F.col(key).isNotNull()).select(F.col(key).alias(f"_key{i}"), F.struct("known_id", *attributes).alias(f"_known{i}"))
        out = out.join(side, F.col(key) == F.col(f"_key{i}"), "left")
    out = out.withColumn("_known", F.coalesce(*[F.col(f"_known{i}") for i in range(len(keys))]))
    same = F.lit(True)
    for a in attributes:
        same = same & F.col(a).eqNullSafe(F.col(f"_known.{a}"))
    action = F.when(F.col("_known").isNull(), "insert").when(same, "same").otherwise("update")
    return out.select(*snapshot.columns, F.col("_known.known_id").alias("known_id"), action.alias("action"))


def unseen(candidates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return candidates.join(seen.select(key), key, "left_anti")


def range_lookup(df: DataFrame, ranges: list[tuple[int, int, int]], value: str, default: int | None = None, name: str = "node") -> DataFrame:
    """The node of the first range [start, end] that holds the value; the rule table is part of the expression."""
    out = F.lit(default).cast("int")
    for start, end, node in reversed(ranges):
        out = F.when(F.col(value).between(start, end), F.lit(node)).otherwise(out)
    return df.withColumn(name, out)
