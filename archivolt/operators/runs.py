"""Batches of questions: ranges, disjoint parts, resuming and overlays of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.session import materialised


def placed(items: DataFrame, order: str, keys: tuple = ()) -> DataFrame:
    """Adds pos, from 1 within keys.  Rows are range-partitioned and their partitions written down once, so that no
    task sorts all of a key and both branches below mean the same partitions."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(items.repartitionByRange(parts, *[F.col(c) for c in (*keys, order)]).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*keys, "_p", "_s")
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(order)))
    same = [ranked[c].eqNullSafe(shift[c]) for c in (*keys, "_p")]
    return ranked.join(F.broadcast(shift) if not keys else shift, same).select(*[ranked[c] for c in items.columns], (F.col("_r") + F.col("_s")).alias("pos"))


def position_range(items: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Rows at positions first..last, both counted; the end may lie beyond the rows."""
    if first < 1 or last < first:
        raise ValueError(f"no range from {first} to {last}")
    return placed(items, order).filter(F.col("pos").between(first, last))


def stride_part(items: DataFrame, order: str, k: int, n: int) -> DataFrame:
    """Part k of n: every n-th row from the k-th; the parts are disjoint and cover all."""
    if not 1 <= k <= n:
        raise ValueError(f"no part {k} of {n}")
    return placed(items, order).filter((F.col("pos") - 1) % n == k - 1)


def pending(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")


def only(items: DataFrame, ids: list) -> DataFrame:
    return items.filter(F.col("id").isin(*ids)) if ids else items.limit(0)


def overlaid(base: DataFrame, part: DataFrame, key: str = "id") -> DataFrame:
    """Base rows with a part's row where it has one; ids of the part that base lacks stop the run."""
    foreign = [r[key] for r in part.join(base, key, "left_anti").select(key).limit(5).collect()]
    if foreign:
        raise ValueError(f"rows of the part are not in the base: {foreign}")
    fresh = part.select(F.col(key).alias("_k"), F.struct(*[F.col(c) for c in part.columns]).alias("_new"))
    return base.join(fresh, base[key] == F.col("_k"), "left").select(
        key, *[F.when(F.col("_k").isNotNull(), F.col(f"_new.{c}")).otherwise(base[c]).alias(c) if c in part.columns else base[c] for c in base.columns if c != key]
    )


def merged(*runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of partial runs, and the ids that more than one row has."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run, allowMissingColumns=True)
    return out, out.groupBy("id").count().filter("count > 1")
