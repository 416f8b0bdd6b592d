"""A table as a set of segments that a manifest names: readers see one version of it or the next, never a mixture.

Segments are folders that nobody changes once a manifest names them. A manifest is one small file for each version;
it appears under its name at once, by a rename, and two writers of one version cannot both succeed. Old segments stay
until vacuum(), so that a reader that opened a version keeps it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.search import merge_postings


class Conflict(RuntimeError):
    """Another writer published the version first."""


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, f"{path}/manifest")
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []


def live(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[dict]]:
    """A version (the newest by default; -1 before the first) and its segments, in the order in which they count."""
    if version is None:
        version = (versions(spark, path) or [-1])[-1]
    if version < 0:
        return -1, []
    return version, [json.loads(r.value) for r in spark.read.text(f"{path}/manifest/{version:012d}.json").collect()]  # a line for each segment


def commit(spark: SparkSession, path: str, base: int, segments: list[dict]) -> int:
    """Publishes the version after `base`."""
    jvm, version = spark.sparkContext._jvm, base + 1
    fs, claim = _files(spark, f"{path}/claims/{version:012d}")
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{version:012d}.json")
    if fs.exists(final) or not fs.createNewFile(claim):
        raise Conflict(f"version {version} of {path}")
    fs.mkdirs(final.getParent())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}/claims/{version:012d}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray("".join(json.dumps(s) + "\n" for s in segments), "utf-8"))
    out.close()
    fs.rename(part, final)
    return version


def write_segment(df: DataFrame, path: str, name: str, tier: int, order: int) -> dict:
    df.write.mode("overwrite").parquet(f"{path}/segments/{name}")
    return {"path": f"segments/{name}", "tier": tier, "order": order, "name": name}


def add_segment(df: DataFrame, path: str, name: str) -> int:
    """Writes the rows as the newest segment and publishes it; a name that is live already is left as it is, so that a
    batch that runs twice counts once."""
    spark = df.sparkSession
    version, had = live(spark, path)
    if any(name in s.get("holds", [s["name"]]) for s in had):
        return version
    return commit(spark, path, version, [*had, write_segment(df, path, name, 0, max((s["order"] for s in had), default=-1) + 1)])


def read_segments(spark: SparkSession, path: str, version: int | None = None, only: list[dict] | None = None) -> DataFrame | None:
    """The rows of a version's segments with `_order`; None where there are none."""
    out = None
    for s in live(spark, path, version)[1] if only is None else only:
        rows = spark.read.parquet(f"{path}/{s['path']}").withColumn("_order", F.lit(s["order"]))
        out = rows if out is None else out.unionByName(rows)
    return out


def newest_postings(rows: DataFrame, key: str) -> DataFrame:
    """Of a term's entries for a document in several segments that of the newest."""
    best = rows.groupBy("term", key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("term", key, "_order")]), "_order").alias("_p"))
    return best.select("term", key, "_p.*")


def read_index(spark: SparkSession, path: str, key: str, base: DataFrame | None = None, version: int | None = None) -> DataFrame | None:
    """The postings of a version, over those of a base table."""
    rows = read_segments(spark, path, version)
    if rows is None:
        return base
    delta = newest_postings(rows, key)
    return delta if base is None else merge_postings([delta, base], key)


def compact(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fanout: int = 4) -> int | None:
    """Merges the segments of the lowest tier that has `fanout` of them into one of the next tier and publishes the new
    set; None if no tier is full. Each row is rewritten once a tier, so that merging costs a logarithm of the segments."""
    version, had = live(spark, path)
    tiers = {t: [s for s in had if s["tier"] == t] for t in {s["tier"] for s in had}}
    full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fanout), None)
    if full is None:
        return None
    made = write_segment(merge(read_segments(spark, path, only=full)), path, uuid.uuid4().hex, full[0]["tier"] + 1, max(s["order"] for s in full))
    made["holds"] = [n for s in full for n in s.get("holds", [s["name"]])]
    gone = {s["name"] for s in full}
    return commit(spark, path, version, sorted([*(s for s in had if s["name"] not in gone), made], key=lambda s: s["order"]))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes the segments that none of the last `keep` versions names; their names."""
    used = {s["path"] for v in versions(spark, path)[-keep:] for s in live(spark, path, v)[1]}
    fs, at = _files(spark, f"{path}/segments")
    gone = [f.getPath() for f in fs.listStatus(at) if f"segments/{f.getPath().getName()}" not in used]
    for p in gone:
        fs.delete(p, True)
    return [p.getName() for p in gone]
