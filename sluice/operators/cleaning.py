"""Catalogue cleaning: schema mapping, value rules, synonyms, audits and merging, over (id, path, ordinal, value) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.joins import small

OK, DOUBTFUL, WRONG = 0, 1, 2
_RECOGNISERS: dict[str, Callable[[Column], Column]] = {}
_CLEANERS: dict[str, Callable[[Column], Column]] = {}


def register_rule(name: str, fn: Callable[[Column], Column], cleaner: bool = False) -> None:
    """A recogniser (column to boolean), or a cleaner (column to string), that rule tables can name."""
    (_CLEANERS if cleaner else _RECOGNISERS)[name] = fn


register_rule("is_percent", lambda c: c.rlike(r"^\d{1,2}%$"))
register_rule("is_english", lambda c: c.rlike("^[a-zA-Z]+$"))
register_rule("always", lambda c: F.lit(True))
register_rule("percent_to_score", lambda c: F.round(F.replace(c, F.lit("%"), F.lit("")).try_cast("double") / 20).cast("int").cast("string"), True)
register_rule("lower", F.lower, True)
register_rule("identity", lambda c: c, True)


def clean_rows(df: DataFrame, site: str, site_column: str = "site", code: str = "exception_code") -> DataFrame:
    return df.where((F.col(code) == OK) & (F.col(site_column) == site))


def flatten_content(df: DataFrame, column: str, key: str, depth: int = 4) -> DataFrame:
    """JSON objects as (key, path, value) leaves, by Spark's VARIANT, which tells a string from an object. A string leaf is
    its characters, whatever they look like; numbers and booleans are text (numbers in their shortest form), a JSON null
    is null, an array is its JSON text, and so is an object below `depth`. An empty object has no leaves. A text that
    is null, no JSON, no object, or has an object with a key twice gives no rows."""
    spark = df.sparkSession
    is_object = lambda c: F.schema_of_variant(c).startswith("OBJECT")
    rows = df.select(key, F.lit("/").alias("_path"), F.try_parse_json(F.col(column).cast("string")).alias("_value"))
    for level in range(depth):
        nested = F.col("_object") if level else F.lit(True)
        opened = rows.lateralJoin(spark.tvf.variant_explode_outer(F.when(nested, F.col("_value")).outer()))
        found = opened.where(~nested | F.col("key").isNotNull()) if level else opened.where("key IS NOT NULL")  # elements of an array have no key
        path = F.when(nested, F.concat("_path", "key", F.lit("/"))).otherwise(F.col("_path"))
        rows = found.select(rows[key], path.alias("_path"), F.when(nested, F.col("value")).otherwise(F.col("_value")).alias("_value"))
        rows = rows.withColumn("_object", F.coalesce(is_object("_value"), F.lit(False)))
    return rows.select(key, F.col("_path").alias("path"), F.expr("try_variant_get(_value, '$', 'string')").alias("value"))


def melt(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns as (id, path, value) rows, the values as text."""
    pairs = F.array(*[F.struct(F.lit(f"/{c}/").alias("path"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(key).alias("id"), F.explode(pairs).alias("_p")).select("id", "_p.path", "_p.value")


def map_schema(rows: DataFrame, mapping: DataFrame, template: str = "template_id") -> DataFrame:
    """Paths renamed by (template, source path); a path without a mapping is dropped."""
    return rows.join(small(mapping), [template, "path"]).drop("path").withColumnRenamed("target", "path")


def check_required(rows: DataFrame, required: list[str], strict: bool = False) -> DataFrame:
    """0, or 1 if a mapped value is null or empty, or 2 if such a path is required; with the paths found. A path that a
    row lacks altogether counts only with strict."""
    empty = F.col("value").isNull() | (F.col("value") == "")
    must = F.col("path").isin(required) if required else F.lit(False)
    out = rows.groupBy("id").agg(
        F.max(F.when(empty & must, WRONG).when(empty, DOUBTFUL).otherwise(OK)).alias("code"),
        F.array_sort(F.collect_set(F.when(empty, F.col("path")))).alias("missing"), F.collect_set(F.when(must, F.col("path"))).alias("_there"),
    )
    if strict:
        absent = F.array_except(F.array(*[F.lit(r) for r in required]), F.col("_there"))
        out = out.withColumn("missing", F.array_sort(F.concat("missing", absent))).withColumn("code", F.when(F.size(absent) > 0, WRONG).otherwise(F.col("code")))
    return out.drop("_there")


def clean_values(rows: DataFrame, rules: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """By path, the first (recogniser, cleaner) whose recogniser accepts makes the value. A path without rules keeps
    its value; one whose rules all refuse keeps it too, with code 1."""
    value, done = F.lit(None).cast("string"), F.lit(False)
    ruled = F.col("path").isin(list(rules)) if rules else F.lit(False)
    cases = []
    for path, pairs in rules.items():
        for test, action in pairs:
            cases.append(((F.col("path") == path) & F.coalesce(_RECOGNISERS[test](F.col("value")), F.lit(False)), _CLEANERS[action](F.col("value"))))
    for when, then in reversed(cases):
        value, done = F.when(when, then).otherwise(value), when | done
    return rows.withColumn("cleaned", F.when(done, value).otherwise(F.col("value"))).withColumn("code", F.when(ruled & ~done, DOUBTFUL).otherwise(OK))


def replace_synonyms(rows: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Values by the canonical word of (path, synonyms array, target); a value of a listed path that no synonym covers
    stays, with code 1."""
    table = synonyms.select("path", F.explode("synonyms").alias("value"), "target").groupBy("path", "value").agg(F.min("target").alias("target"))
    listed = synonyms.select("path", F.lit(True).alias("_listed")).distinct()
    out = rows.join(small(table), ["path", "value"], "left").join(small(listed), "path", "left")
    return out.withColumn("canonical", F.coalesce("target", "value")).withColumn("code", F.when(F.col("_listed") & F.col("target").isNull(), DOUBTFUL).otherwise(OK)).drop("target", "_listed")


def normalise_whitespace(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.trim(F.regexp_replace(c, r"\s+", " ")) for c in columns})


def audit_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that are null or empty in each row, and code 1 if there are any."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in columns]))
    return df.withColumn("missing", missing).withColumn("code", (F.size("missing") > 0).cast("int"))


def assign_row_key(df: DataFrame, source: str, key: str, name: str = "row_key") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.concat(F.col(source).cast("string"), F.col(key).cast("string")), F.uuid()))


def attributes_to_map(df: DataFrame, column: str, separator: str, name: str = "attributes") -> DataFrame:
    """Lines key, separator, value as a map; lines without a separator or that end with it are skipped, and of equal
    keys the last counts."""
    lines = F.filter(F.split(column, "\n"), lambda x: x.contains(separator) & ~x.endswith(separator))
    piece = lambda x, i: F.trim(F.split_part(x, F.lit(separator), F.lit(i)))
    pairs = F.reverse(F.transform(lines, lambda x: F.struct(piece(x, 1).alias("k"), piece(x, 2).alias("v"))))
    seen = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda a, x: F.when(F.array_contains(F.transform(a, lambda y: y["k"]), x["k"]), a).otherwise(F.concat(a, F.array(x))))
    return df.withColumn(name, F.map_from_entries(seen))


def unwrap_jsonp(df: DataFrame, column: str, schema: str, name: str = "parsed") -> DataFrame:
    return df.withColumn(name, F.from_json(F.regexp_extract(column, r"(?s)^[^(]*\((.*)\)\s*;?\s*$", 1), schema))


def split_multi(df: DataFrame, column: str, separator: str = "##", name: str = "parts") -> DataFrame:
    return df.withColumn(name, F.split(column, rf"\Q{separator}\E"))


def score_items(rows: DataFrame, key: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(key, label, raw) rows as an array of label, value, type: a width in px makes stars (a sixteenth), a percentage
    a score (a twentieth, rounded), anything else stays text."""
    raw = F.col("raw")
    value = F.when(raw.endswith("px"), F.round(F.replace(raw, F.lit("px"), F.lit("")).try_cast("double") / 16).cast("int").cast("string"))
    value = value.when(raw.endswith("%"), F.round(F.replace(raw, F.lit("%"), F.lit("")).try_cast("double") / 20).cast("int").cast("string")).otherwise(raw)
    kind = F.when(raw.endswith("px"), "stars").when(raw.endswith("%"), "percent").otherwise("text")
    kept = rows.where(~F.col("label").isin(list(exclude))) if exclude else rows
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("label", value.alias("value"), kind.alias("type")))).alias("items"))


def strip_markup(df: DataFrame, column: str, most: int, name: str = "plain") -> DataFrame:
    text = F.regexp_replace(F.regexp_replace(column, r"[\x{10000}-\x{10FFFF}]", ""), "<[^>]*>", "")
    return df.withColumn(name, F.substring(text, 1, most))


def extract_mentions(df: DataFrame, column: str) -> DataFrame:
    """Ordered parts of a text, type at (a name after @) or str, with the text without mentions."""
    parts = F.filter(F.regexp_extract_all(column, F.lit(r"@[^\s@]+|[^@]+|@"), 0), lambda x: x != "")
    typed = F.transform(parts, lambda x: F.struct(F.when(x.rlike(r"^@[^\s@]+$"), "at").otherwise("str").alias("type"), F.regexp_replace(x, "^@(?=.)", "").alias("value")))
    return df.withColumn("parts", typed).withColumn("clean_text", F.trim(F.regexp_replace(column, r"@[^\s@]+", "")))


def filter_response(df: DataFrame, least: float = 60, weight: str = "weight") -> DataFrame:
    return df.where(F.col(weight) >= least)


def item_id(*columns: str) -> Column:
    """The MD5 of the parts that are not empty; empty if all are."""
    joined = F.concat_ws("", *[F.when(F.col(c) != "", F.col(c)) for c in columns])
    return F.when(joined == "", "").otherwise(F.md5(joined))


def survivor(policy: str, column: str, order: str) -> Column:
    """The value that a merged entity keeps of a column: first_non_empty, most_frequent, union_values or longest."""
    value = F.when(F.col(column).cast("string") != "", F.col(column))
    if policy == "first_non_empty":
        return F.min_by(value, F.when(value.isNotNull(), F.col(order)))
    if policy == "most_frequent":
        return F.mode(value, True)
    if policy == "union_values":
        return F.array_join(F.array_sort(F.collect_set(value.cast("string"))), "|")
    if policy == "longest":
        return F.max_by(value, F.struct(F.length(value), F.negate(F.col(order))))
    raise ValueError(policy)


def merge_entities(df: DataFrame, core: list[str], policies: dict[str, str], order: str) -> DataFrame:
    """One row for each item id of the core columns."""
    rows = df.withColumn("item_id", item_id(*core))
    return rows.groupBy("item_id").agg(F.count("*").alias("n"), *[survivor(p, c, order).alias(c) for c, p in policies.items()])
