"""Statement-log statistics: frequency, load, latency, heat, slow and large statements, trailing means.

A log has user, sql_type, sql, sql_rows, exec_ms, net_in, net_out, end_ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

READS, WRITES = ("SELECT", "SHOW"), ("UPDATE", "INSERT", "DELETE", "REPLACE")


def fingerprint(sql: Column) -> Column:
    """The statement with literals as ? and white space as one blank."""
    out = F.regexp_replace(sql, r"'[^']*'", "?")
    out = F.regexp_replace(out, r"\b[0-9]+(\.[0-9]+)?\b", "?")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def statement_frequency(log: DataFrame, most: int = 1024) -> DataFrame:
    """The hottest statements; min counts times over 0 only, the mean is cut to whole milliseconds."""
    out = log.groupBy(fingerprint(F.col("sql")).alias("statement")).agg(
        F.count("*").alias("n"), F.min(F.when(F.col("exec_ms") > 0, F.col("exec_ms"))).alias("least_ms"), F.max("exec_ms").alias("most_ms"),
        F.expr("sum(exec_ms) div count(*)").alias("mean_ms"), F.max("end_ts").alias("last_ts"), F.sum("exec_ms").alias("total_ms"),
    )
    return out.orderBy(F.desc("n"), F.desc("last_ts"), F.desc("total_ms"), "statement").limit(most)


def read_write_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("user").agg(
        F.count_if(F.col("sql_type").isin(*READS)).alias("reads"), F.count_if(F.col("sql_type").isin(*WRITES)).alias("writes"),
        F.sum("net_in").alias("net_in"), F.sum("net_out").alias("net_out"), F.max("end_ts").alias("last_ts"),
    )


def latency_histogram(log: DataFrame) -> DataFrame:
    ms, names = F.col("exec_ms"), ["le_10", "le_200", "le_1000", "over_1000"]
    bucket = F.when(ms <= 10, names[0]).when(ms <= 200, names[1]).when(ms <= 1000, names[2]).otherwise(names[3])
    return log.select("user", bucket.alias("bucket")).groupBy("user").pivot("bucket", names).agg(F.count(F.lit(1))).na.fill(0)


def time_of_day_histogram(log: DataFrame, zone: str = "UTC") -> DataFrame:
    hour = F.hour(F.from_utc_timestamp("end_ts", zone))
    part = F.when((hour < 6) | (hour >= 22), "22-06").when(hour < 13, "06-13").when(hour < 18, "13-18").otherwise("18-22")
    return log.groupBy("user", part.alias("part")).agg(F.count("*").alias("n"))


def tables_of(sql: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda t: F.lower(t)))


def table_heat(log: DataFrame) -> DataFrame:
    """Of each statement's first table: reads, writes, last use, and the tables used with it."""
    rows = log.withColumn("t", tables_of(F.col("sql"))).where(F.size("t") > 0).withColumn("main", F.col("t")[0])
    heat = rows.groupBy("main").agg(F.count_if(F.col("sql_type").isin(*READS)).alias("reads"), F.count_if(F.col("sql_type").isin(*WRITES)).alias("writes"), F.max("end_ts").alias("last_ts"))
    along = rows.select("main", F.explode(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))).alias("other")).groupBy("main", "other").agg(F.count("*").alias("k"))
    along = along.groupBy("main").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", "k"))), lambda x: F.concat(x["other"], F.lit("="), x["k"].cast("string"))), ",").alias("used_with"))
    return heat.join(along, "main", "left").withColumn("used_with", F.coalesce("used_with", F.lit("")))


def condition_value_counts(log: DataFrame, table: str, column: str) -> DataFrame:
    """Literals that a column of a table is compared with for equality."""
    rows = log.where(F.array_contains(tables_of(F.col("sql")), table.lower()))
    found = F.regexp_extract_all(F.col("sql"), F.lit(rf"(?i)\b{column}\s*=\s*('[^']*'|[0-9.]+)"), 1)
    return rows.select(F.explode(found).alias("literal")).groupBy(F.trim(F.translate("literal", "'", " ")).alias("literal")).agg(F.count("*").alias("n"))


def result_size_by_statement(log: DataFrame) -> DataFrame:
    return log.groupBy(fingerprint(F.col("sql")).alias("statement")).agg(F.count("*").alias("n"), F.max_by("sql_rows", F.struct("end_ts", "sql_rows")).alias("last_rows"))


def command_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("sql_type").agg(F.count("*").alias("n"))


def slow_statements(log: DataFrame, ms: int = 100, n: int = 10) -> DataFrame:
    return log.where(F.col("exec_ms") >= ms).orderBy(F.desc("exec_ms"), "id").limit(n)


def large_results(log: DataFrame, rows: int = 10_000, n: int = 10) -> DataFrame:
    return log.where((F.col("sql_type") == "SELECT") & (F.col("sql_rows") > rows)).orderBy(F.desc("sql_rows"), "id").limit(n)


def trailing_averages(df: DataFrame, key: str, ts: str, value: str, minutes: tuple[int, ...] = (1, 10, 30)) -> DataFrame:
    """The mean of the values of the last minutes at every observation; negative values do not count.

    A key's rows are parted into spans of time, four times the longest window; the rows that the next span looks back
    to are copied into it. So a key with many rows fills many tasks."""
    longest = max(minutes) * 60_000_000
    span = 4 * longest
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.where(F.col(value) >= 0).withColumn("_t", micros).withColumn("_v", F.col(value).cast("decimal(24,4)")).withColumn("_own", F.floor(F.col("_t") / F.lit(span)))
    reaches = F.col("_t") >= (F.col("_own") + 1) * span - longest
    out = rows.withColumn("_span", F.explode(F.when(reaches, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    # Both frames only grow, so that Spark adds each row to them once; a frame of m minutes is worked out anew for every row.
    own = Window.partitionBy(key, "_span").orderBy("_t")
    until = lambda end: F.struct(F.sum("_v").over(own.rangeBetween(Window.unboundedPreceding, end)).alias("sum"), F.count("_v").over(own.rangeBetween(Window.unboundedPreceding, end)).alias("n"))
    out = out.withColumns({"_now": until(0), **{f"_before_{m}": until(-m * 60_000_000 - 1) for m in minutes}})
    for m in minutes:
        now, before = F.col("_now"), F.col(f"_before_{m}")
        out = out.withColumn(f"avg_{m}m", F.round((now["sum"] - F.coalesce(before["sum"], F.lit(0))).cast("double") / (now["n"] - before["n"]), 4))
    return out.where(F.col("_span") == F.col("_own")).drop("_t", "_v", "_own", "_span", "_now", *[f"_before_{m}" for m in minutes])


def last_n(df: DataFrame, key: str, ts: str, tie: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def page_size_histogram(pages: DataFrame) -> DataFrame:
    size = F.octet_length("html")
    return pages.groupBy(F.least(F.floor(size / F.lit(4096)), F.lit(24)).cast("int").alias("bucket")).agg(F.count("*").alias("pages"), F.sum(size).alias("bytes"), F.round(F.sum(size) / F.count("*"), 4).alias("mean"))


def fetch_outcomes(log: DataFrame, code: str) -> DataFrame:
    return log.groupBy(code).agg(F.count("*").alias("n"))


def throughput_histogram(events: DataFrame, ts: str, unit: str) -> DataFrame:
    return events.groupBy(F.window(F.col(ts), f"1 {unit}").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
