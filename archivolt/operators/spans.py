"""Places of citations as rows: located by a table function, merged in windows, spliced by a fold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import arrow_udtf

from archivolt.functions.grammar import GRAMMAR, fold_in_place, gate


@arrow_udtf(returnType="id long, begin int, end int, body string")
class Locate:
    """A row for every place in texts(id, text) that names a body."""

    def eval(self, texts: pa.RecordBatch) -> Iterator[pa.Table]:
        ids, begins, ends, bodies = [], [], [], []
        for key, text in zip(texts.column("id").to_pylist(), texts.column("text").to_pylist(), strict=True):
            for m in GRAMMAR.mentions(fold_in_place(text or "")):
                ids.append(key), begins.append(m.begin), ends.append(m.end), bodies.append("|".join(x or "" for x in m.body))
        yield pa.table({"id": pa.array(ids, pa.int64()), "begin": pa.array(begins, pa.int32()), "end": pa.array(ends, pa.int32()), "body": pa.array(bodies, pa.string())})


def located(texts: DataFrame) -> DataFrame:
    """id, begin, end and body of every mention in texts(id, text).  Texts without a word that a citation begins with don't
    leave the JVM; the function takes whole batches, so a text is no partition of its own."""
    return Locate(texts.filter(gate(F.col("text"))).select(F.col("id").cast("long").alias("id"), "text").asTable())


def merged(spans: DataFrame) -> DataFrame:
    """id, begin, end and bodies of runs of spans(id, begin, end, body) that overlap or touch: a span begins a run where no
    earlier one of its text reaches it."""
    by = Window.partitionBy("id").orderBy("begin", "end")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("starts", (reached.isNull() | (F.col("begin") > reached)).cast("int"))
    runs = starts.withColumn("run", F.sum("starts").over(by))
    return runs.groupBy("id", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_sort(F.collect_set("body")).alias("bodies")).drop("run")


def spliced(texts: DataFrame, runs: DataFrame, by: Column) -> DataFrame:
    """texts(id, text) with each of runs(id, begin, end, ..) replaced by `by`, from the last to the first, so that what is
    replaced later keeps its place."""
    cuts = runs.select("id", F.struct("begin", "end", by.alias("by")).alias("cut")).groupBy("id").agg(F.reverse(F.array_sort(F.collect_list("cut"))).alias("cuts"))
    fold = F.aggregate("cuts", F.col("text"), lambda t, c: F.concat(F.substring(t, F.lit(1), c["begin"]), c["by"], F.substring(t, c["end"] + 1, F.length(t))))
    return texts.join(cuts, "id", "left").select("id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(fold).alias("text"))
