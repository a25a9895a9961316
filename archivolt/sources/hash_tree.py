"""Hash trees of files: fixed ranges are hashed in parallel, and hashes of hashes give a root for each file."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.sources.files import opened, scan

#: Bytes of a range, hashes that one above them takes, and bytes that are read at a time.
RANGE, FAN, READ = 64 << 20, 1024, 1 << 20


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, offset and bytes of every range of every file below path; an empty file has one of no bytes."""
    files = scan(spark, path, read="false").select("path", F.col("bytes").alias("length"))
    offsets = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    return files.select("path", "length", F.explode(offsets).alias("offset")).select("path", "offset", F.least(F.lit(size), F.col("length") - F.col("offset")).alias("bytes"))


def leaves(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, offset, bytes and hash (SHA-256) of every range: whatever the size of a file, a task reads ranges of it."""
    found = ranges(spark, path, size)

    def hashed(batches):
        store = opened(path)[0]
        for batch in batches:
            out = []
            for name, offset, n in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "bytes")], strict=True):
                state = hashlib.sha256()
                with store.open_input_file(name) as file:
                    file.seek(offset)
                    while n > 0 and (block := file.read(min(n, READ))):
                        state.update(block)
                        n -= len(block)
                if n:
                    raise OSError(f"{name} has changed while it was read")
                out.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "hash"])

    total = found.count()
    dealt = found.repartition(max(1, min(total, spark.sparkContext.defaultParallelism * 4)), "path", "offset")
    return dealt.mapInArrow(hashed, "path string, offset long, bytes long, hash string")


def roots(hashed: DataFrame, fan: int = FAN) -> DataFrame:
    """path, ranges and root of leaves(): the hashes of each `fan` in order are hashed as one, level by level, until a file
    has one left (the leaf of a file of one range is hashed once more)."""
    by = F.row_number().over(Window.partitionBy("path").orderBy("offset")) - 1
    level = hashed.select("path", by.alias("i"), "hash")
    counts = hashed.groupBy("path").agg(F.count(F.lit(1)).alias("ranges"))
    left = counts.agg(F.max("ranges")).first()[0] or 0
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "hash"))), lambda x: x["hash"]), "")
        level = level.groupBy("path", F.floor(F.col("i") / fan).alias("i")).agg(F.sha2(joined, 256).alias("hash"))
        left = -(-left // fan)
        if left <= 1:
            return counts.join(level.select("path", F.col("hash").alias("root")), "path")


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, offset and problem (missing, extra or changed) of ranges that differ between two tables of leaves."""
    both = before.select("path", "offset", F.col("hash").alias("was")).join(after.select("path", "offset", "hash"), ["path", "offset"], "full")
    problem = F.when(F.col("hash").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("was") != F.col("hash"), "changed")
    return both.select("path", "offset", problem.alias("problem")).filter("problem is not null")
