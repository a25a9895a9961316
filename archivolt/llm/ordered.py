"""A total order over all rows in ranges, so that sums before a row need no single task, however large one key is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.llm.shared import written

#: Words are runs without ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def in_blocks(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df, written, with `block`: ranges of the order `by` of about equal size, numbered in that order.  Rows with equal
    values of `by` share a block, so it should end in a number of the row."""
    return written(df.repartitionByRange(*by).withColumn("block", F.spark_partition_id()), name)


def before_blocks(df: DataFrame, keys: list[str], sums: dict[str, Callable[[], Column]], none: int = 0) -> DataFrame:
    """One row for each (keys, block) with, for each name of `sums`, its aggregate over the blocks before, within keys."""
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    spans = df.groupBy(*keys, "block").agg(*[make(F.col(name)).alias(name) for name, make in sums.items()])
    return spans.select(*keys, "block", *[F.coalesce(make(F.col(name)).over(earlier), F.lit(none)).alias(name) for name, make in sums.items()])


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORDS)).cast("long")
