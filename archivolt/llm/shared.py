"""Helpers shared by the operators of this package: written tables, ranks without a single task, Arrow words."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only in a single-JVM session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("archivolt.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="archivolt-")
    spark.conf.set("archivolt.shared.dir", made)
    return made


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/archivolt/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._archivolt_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by written() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_archivolt_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def salts(rows: int, per_task: int = 20_000) -> int:
    """How many salts a key is dealt to so that no task gets much more than per_task rows of it."""
    return int(max(32, min(1 << 20, rows // per_task)))


def ranked(df: DataFrame, keys: list[str], order: list, n_salts: int, to: str, salt: Column | None = None) -> DataFrame:
    """Adds a gapless rank from 0 within keys.  Rows of a key are dealt to salts; each salt is ranked on its own and
    shifted by the counts of the salts before it, so that not even a key of all rows meets in one task."""
    salt = salt if salt is not None else F.xxhash64(*order)
    df = df.withColumn("_salt", F.pmod(salt, F.lit(n_salts)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        df.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    within = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)) - F.lit(1)
    placed = df.withColumn("_rank", within)
    cond = [placed[c].eqNullSafe(shift[c]) for c in [*keys, "_salt"]]
    return placed.join(shift, cond).select(*[placed[c] for c in placed.columns if c not in ("_salt", "_rank")], (F.col("_rank") + F.col("_shift")).cast("long").alias(to))


def texts_of(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty texts and 64-bit offsets that start at 0, as Arrow's string kernels need
    them for slices."""
    full = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1] if len(full) else np.zeros(1, np.int64)
    data = full.buffers()[2]
    data = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if data is not None else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(full), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), data)


def slices(batches, most_bytes: int = 8 << 20, most_rows: int = 1 << 20):
    """Record batches cut so that column `text` holds about most_bytes, of at most most_rows rows; a longer single text
    stays whole."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = min(start + most_rows, max(start + 1, int(np.searchsorted(size, base + most_bytes, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of a large_string array: distinct ones, their numbers in turn, and the
    offsets by text."""
    parts = pc.ascii_split_whitespace(texts)
    flat, offsets = parts.values, parts.offsets.to_numpy().astype(np.int64)
    flat = flat.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else flat
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary
    empty = pc.index(words, "").as_py() if len(words) else -1
    if empty >= 0:  # at the ends of a text
        keep = index != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        index = index[keep]
    return words, index, offsets


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    words, index, offsets = coded_words(texts)
    return words.to_pylist(), index.astype(np.int64), offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def remove_shared(spark: SparkSession) -> None:
    """For tests: drops the temporary folder of a single-JVM session."""
    import shutil

    found = spark.conf.get("archivolt.shared.dir", None)
    if found and found.startswith("file://") and os.path.isdir(found[7:]):
        shutil.rmtree(found[7:], ignore_errors=True)
        spark.conf.unset("archivolt.shared.dir")
