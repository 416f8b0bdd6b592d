"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts lineage: a lost executor costs the tasks that read it, not the jobs before it.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset in a session of one machine, as in tests, a new temporary
    folder becomes it; on a cluster, whose executors would not see that folder, this is an error."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; the executors of {master} need a folder that they share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-sluice-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that are over; it does so when the driver's JVM collects
    its garbage, which a driver with little to do may put off for half an hour."""
    spark.range(1).count()  # Spark holds on to the plan that ran last; now that is this one
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)  # the cleaner works beside the driver


class Scratch:
    """Parquet tables that one operator writes for itself.

    save() runs a plan and gives back its stored rows; drop() deletes tables that nothing reads any more. A table
    that the returned, still lazy, DataFrame reads is left in the shared folder, whose owner clears it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}, 0

    def save(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """free: the plan shuffles much, which is not needed once it is stored."""
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        df.write.parquet(path)
        if free:
            free_shuffles(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[0])
            path.getFileSystem(conf).delete(path, True)
