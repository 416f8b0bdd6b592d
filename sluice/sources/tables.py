"""Sources and sinks: tables, delimited text, JSON lines, upserts and published snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scan_table(spark: SparkSession, path: str, key: str | None = None, after=None, columns: list[str] | None = None, jdbc: dict | None = None) -> DataFrame:
    """Rows with a key over `after`, read in splits; with jdbc options (url, dbtable, partitionColumn, bounds), over JDBC."""
    df = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
    df = df if after is None else df.where(F.col(key) > after)
    return df.select(*columns) if columns else df


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", quote: str = '"', escape: str = "\\", line_sep: str = "\n") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, quote=quote, escape=escape, lineSep=line_sep)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", quote: str = '"', escape: str = "\\") -> None:
    df.write.csv(path, sep=sep, quote=quote, escape=escape)


def write_json_docs(df: DataFrame, path: str) -> None:
    """One JSON object a line; characters beyond ASCII stay as they are."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quoteAll=True)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; among equally new ones an update replaces what was there."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def checksum(df: DataFrame) -> DataFrame:
    """One row: rows and the sum of row hashes, whatever the order of rows."""
    hashed = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("checksum"))


def publish_snapshot(df: DataFrame, path: str, version: int, min_rows: int) -> bool:
    """Writes version=<n> and then a manifest row, if the stored rows are enough; a version is never overwritten."""
    spark, at = df.sparkSession, f"{path}/data/version={version}"
    df.write.parquet(at)
    found = checksum(spark.read.parquet(at)).first()
    if found.n < min_rows:
        return False
    row = spark.createDataFrame([(version, at, found.n, found.checksum)], "version bigint, path string, n bigint, checksum string")
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def read_snapshot(spark: SparkSession, path: str, newer_than: int = -1) -> DataFrame | None:
    """The newest published version over `newer_than`, if its checksum still holds; else nothing."""
    last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).limit(1).first()
    if last is None or last.version <= newer_than:
        return None
    df = spark.read.parquet(last.path)
    found = checksum(df).first()
    return df if (found.n, found.checksum) == (last.n, last.checksum) else None


def write_pages_by_host(df: DataFrame, path: str, host: str = "host") -> None:
    """A folder for each host; a hot host's pages are rebalanced into several files."""
    df.hint("rebalance", host).write.partitionBy(host).parquet(path)
