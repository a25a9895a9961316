"""Sessions: settings the engine expects, and making the package known to the executors' Python."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent


def attach(spark: SparkSession) -> SparkSession:
    """Lets executors import this package: by path where they share the driver's disk, else as a zip sent to them."""
    context = spark.sparkContext
    held = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) not in held:
        context.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, held)])
        if not context.master.startswith("local"):
            made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "archivolt"), "zip", ROOT, "archivolt")
            context.addPyFile(made)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only in a single-JVM session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("archivolt.work.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="archivolt-")
    spark.conf.set("archivolt.work.dir", made)
    return made


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{work_dir(spark)}/archivolt/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what is computed once means the same in every branch of a plan."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before work that costs more than moving its rows: a file of one row group is one task's, however
    many cores there are and however many splits it is read in, as all but one of them are empty.  What has rows in as many
    partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < cores or df.select(F.spark_partition_id().alias("part")).distinct().count() < cores
    return df.repartition(cores) if few else df


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benches."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return attach(spark)
