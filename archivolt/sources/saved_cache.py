"""A cache of values by key, in buckets: looked up without moving the cache, appended to and compacted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


class BucketedCache:
    """Values by key as a table bucketed by key in a folder that all share.

    A lookup deals the asked rows to the cache's buckets and joins bucket by bucket, so whatever the cache holds it is
    read in place.  Rows are appended a file a bucket; compact() makes them one again, of each key the first that came."""

    def __init__(self, spark: SparkSession, path: str, values: str, buckets: int = 64):
        """values: the columns beside key, as a schema string."""
        self.spark, self.path, self.values, self.buckets = spark, path.rstrip("/"), values, buckets
        self.name = f"archivolt_cache_{uuid.uuid4().hex}"
        self.columns = ["key", *[c.split()[0] for c in values.split(",")]]
        self.opened(self.path)

    def opened(self, path: str) -> None:
        self.at = path
        columns = f"key string, {self.values}, turn long"
        self.spark.sql(f"create table {self.name} ({columns}) using parquet clustered by (key) into {self.buckets} buckets location '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "key")

    def misses(self, rows: DataFrame) -> DataFrame:
        """Distinct keys of rows(key, ..) that the cache lacks, with one row of each."""
        return self.dealt(rows.filter("key is not null")).dropDuplicates(["key"]).join(self.table().select("key"), "key", "left_anti")

    def found(self, rows: DataFrame) -> DataFrame:
        """rows(key, ..) with their values, null where there are none."""
        return self.dealt(rows).join(self.table().select(*self.columns), "key", "left")

    def append(self, rows: DataFrame, turn: int = 0) -> None:
        """Adds rows(key, values); `turn` orders what is there twice."""
        kinds = {f.name: f.dataType for f in self.table().schema}
        made = self.dealt(rows).select(*[F.col(c).cast(kinds[c]).alias(c) for c in self.columns], F.lit(turn).cast("long").alias("turn"))
        made.write.mode("append").format("parquet").bucketBy(self.buckets, "key").saveAsTable(self.name)

    def compact(self) -> None:
        """One file a bucket, one row a key, in a new folder that takes the place of the old one."""
        by = Window.partitionBy("key").orderBy("turn")
        kept = self.table().withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
        new, path = f"{self.name}_{uuid.uuid4().hex}", f"{self.path}-{uuid.uuid4().hex}"
        kept.write.format("parquet").bucketBy(self.buckets, "key").option("path", path).saveAsTable(new)
        self.spark.sql(f"drop table {self.name}")  # its files stay for whoever still reads them
        self.name, self.at = new, path
