"""Costly work on tables of a single row group, and windows packed in tasks."""

import random

import pytest
from pyspark.sql import functions as F

from archivolt.operators import segment
from archivolt.plans.catalog import QUERIES
from archivolt.session import spread


def parts(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_row_group_in_many_splits(spark, tmp_path):
    """A row group is read by the task that has its middle, so all other splits of its file are empty."""
    path = str(tmp_path / "rows")
    spark.range(20000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(path)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= 4 and parts(read) == 1
        assert parts(spread(read)) >= 4 and spread(read).count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


@pytest.mark.parametrize("name", ["delivered_answers", "docx_paragraphs", "evidence_bodies", "article_segments"])
def test_customers_are_spread(spark, sf, name):
    assert "Repartition 4" in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def by_fold(lines, words=12, overlap=0.25):
    """Windows by looking at every line anew."""
    units = []
    for line in lines:
        split = line.split()
        step = int(words * (1 - overlap))
        units += [(" ".join(split[s : s + words]), len(split[s : s + words])) for s in range(0, max(1, len(split) - words + step), step)] if len(split) > words else [(line.strip(), len(split))] if split else []
    out, window = [], []
    for unit in units:
        if window and sum(n for _, n in window) + unit[1] > words:
            out.append(window)
            fit = [i for i in range(len(window) + 1) if sum(n for _, n in window[len(window) - i :]) <= words * overlap]
            window = window[len(window) - max(fit) :]
        window = [*window, unit]
    return ["\n".join(t for t, _ in w) for w in [*out, window] if w]


def test_windows_are_packed_in_tasks(spark):
    r = random.Random(3)
    texts = [[" " * r.randint(0, 2) + " ".join(str(r.randint(0, 9)) for _ in range(r.choice([0, 1, 2, 3, 9, 12, 13, 40]))) + r.choice(["", " ", "　"]) for _ in range(r.randint(0, 30))] for _ in range(60)]
    found = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "id int, t string").select("id", segment.windows_of("t", 12, 0.25).alias("w"))
    assert {x.id: x.w for x in found.collect()} == {i: by_fold(t) for i, t in enumerate(texts)}
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
