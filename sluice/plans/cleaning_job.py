"""The cleaning job: mapping, value rules and synonyms in order, each over rows without exceptions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import cleaning as C

NEW, RUNNING, DONE, FAILED = 0, 1, 2, 3


@dataclass
class Tables:
    """Rule tables: (template_id, path, target); required paths; rules by path; (path, synonyms, target)."""

    mapping: DataFrame
    required: list[str]
    rules: dict[str, list[tuple[str, str]]]
    synonyms: DataFrame
    statuses: list[int] = field(default_factory=lambda: [NEW])


def run_cleaning(rows: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Clean (id, path, value) rows and the rejects (id, stage, code); a stage sees only ids that no stage rejected.
    The statuses of the run end with DONE, or with FAILED if a stage cannot be planned."""
    tables.statuses.append(RUNNING)
    try:
        mapped = C.map_schema(rows, tables.mapping)
        missing = C.check_required(mapped, tables.required).where(F.col("code") == C.WRONG).select("id", F.lit("required").alias("stage"), "code")
        cleaned = C.clean_values(mapped.join(missing, "id", "left_anti").select("id", "path", "value"), tables.rules)
        refused = cleaned.where("code <> 0").select("id", F.lit("values").alias("stage"), "code").distinct()
        named = C.replace_synonyms(cleaned.join(refused, "id", "left_anti").select("id", "path", F.col("cleaned").alias("value")), tables.synonyms)
        unknown = named.where("code <> 0").select("id", F.lit("synonyms").alias("stage"), "code").distinct()
        out = named.join(unknown, "id", "left_anti").select("id", "path", F.col("canonical").alias("value"))
    except Exception:
        tables.statuses.append(FAILED)
        raise
    tables.statuses.append(DONE)
    return out, missing.union(refused).union(unknown)


def fill_entities(rows: DataFrame, key: str = "id") -> DataFrame:
    """Clean rows as one map of path and value for each entity."""
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "value")))).alias("attributes"))


def fill_checked(entities: DataFrame, checked_by: str) -> DataFrame:
    return entities.withColumn("checked_by", F.lit(checked_by))
