"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked.  Rows of a group that carry the same label are interchangeable, so the state
is one row for each (group, label) with its count: a group of any size has at most as many rows as there are shards.
In each round the rows of a group move towards the label that holds most of the group among those with room; the moves
into a shard, the largest first, are granted while they fit its quota.  Unlinked rows are indifferent and fill what the
linked ones leave.  Quotas are the law `rows`: counts of shards differ by one at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.llm.shared import dropped, ranked, salts, table, written

ROUNDS = 12


def running(df: DataFrame, keys: list[str], order: list, n: str, to: str, buckets: int = 256) -> DataFrame:
    """Adds the sum of n over the rows before, within keys, in the order (bucket of _by, order).  Sums of buckets are
    shifted, so that no key meets in one task."""
    placed = df.withColumn("_b", F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy(*keys, "_b").agg(F.sum(n).alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("_w", F.coalesce(F.sum(n).over(within), F.lit(0))).join(F.broadcast(shift), [*keys, "_b"]).withColumn(to, F.col("_w") + F.col("_shift")).drop("_b", "_w", "_shift")


def quotas(total: int, shards: int):
    """The rows that shard number `shard` takes."""
    return F.floor((F.col("shard") + 1) * F.lit(total) / shards) - F.floor(F.col("shard") * F.lit(total) / shards)


def propagated(state: DataFrame, total: int, shards: int) -> DataFrame:
    """state(grp, shard, n) of linked rows after the rounds; the load of a shard grows by moves within its quota only."""
    spark = state.sparkSession
    every = F.broadcast(spark.range(shards).select(F.col("id").cast("int").alias("shard")).withColumn("quota", quotas(total, shards)))
    for _ in range(ROUNDS):
        loads = state.groupBy("shard").agg(F.sum("n").alias("load"))
        room = every.join(loads, "shard", "left").select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("room"))
        roomy = state.join(F.broadcast(room), "shard")
        # the label with most of the group that can take more of it; rows leave no larger part of the group for it
        rank = F.struct(F.when(F.col("room") > 0, 1).otherwise(0), F.col("n"), -F.pmod(F.xxhash64("grp", "shard"), F.lit(1 << 30)))
        best = F.max_by(F.struct("shard", "n"), rank).over(Window.partitionBy("grp"))
        aimed = roomy.withColumn("best", best).withColumn("to", F.col("best.shard"))
        asks = aimed.filter((F.col("shard") != F.col("to")) & (F.col("n") <= F.col("best.n"))).select("grp", "shard", "to", "n")
        ordered = running(asks.withColumnRenamed("shard", "from"), ["to"], [F.desc("n"), "grp", "from"], "n", "ahead")
        granted = ordered.join(F.broadcast(room.select(F.col("shard").alias("to"), "room")), "to").withColumn("moved", F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.col("ahead")))).filter("moved > 0")
        gains = granted.select("grp", F.col("to").alias("shard"), F.col("moved").alias("n"))
        losses = granted.select("grp", F.col("from").alias("shard"), (-F.col("moved")).alias("n"))
        after = written(state.union(gains).union(losses).groupBy("grp", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "labels")
        moved = after.join(state.withColumnRenamed("n", "was"), ["grp", "shard"], "left").filter("n > coalesce(was, 0)").isEmpty()
        dropped(state)
        state = after
        if moved:
            break
    return state


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Puts every row of docs(doc_id, text) into a shard, equal texts together as far as quotas allow.

    Returns doc_id, size (UTF-8 bytes of the text, null: none, plus 8), text_crc32 (unsigned), shard and slot (gapless
    from 0 within a shard).  Counts of shards differ by one at most, also where fewer rows than shards exist.  A null
    text equals other nulls and the empty text; repeated rows and null doc_ids are placed like others; a group larger
    than a shard is split over as few as have room.  Texts of any length are hashed whole; ties between shards fall by a
    hash of group and shard; other columns are ignored; no rows give no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "rows",
    )
    total = rows.count()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    start = F.pmod(F.xxhash64("uid", "doc_id"), F.lit(shards)).cast("int")
    cells = written(rows.groupBy("grp", start.alias("shard")).agg(F.count(F.lit(1)).alias("n")), "cells")
    linked = cells.groupBy("grp").agg(F.sum("n").alias("whole")).filter("whole > 1").select("grp")
    state = written(cells.join(linked, "grp").select("grp", "shard", "n"), "labels")
    state = propagated(state, total, shards)
    # rows of a group, in turn, take its labels' counts
    turns = state.withColumn("from", F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lists = turns.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("from", "shard"))).alias("turns"))
    many = salts(total)
    placed = ranked(rows.select("grp", "uid"), ["grp"], ["uid"], many, "rank").join(lists, "grp", "left")
    labelled = written(
        placed.select(
            "uid",
            F.coalesce(F.element_at(F.filter("turns", lambda t: t["from"] <= F.col("rank")), -1)["shard"], F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).alias("shard"),
            F.col("turns").isNotNull().alias("linked"),
        ),
        "labelled",
    )
    # linked rows keep their place as long as the quota holds them; what is over goes where rows are missing
    taken = labelled.groupBy("shard").agg(F.sum(F.col("linked").cast("int")).alias("tied"), F.count(F.lit(1)).alias("load"))
    spark = docs.sparkSession
    plan = written(spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(taken, "shard", "left").fillna(0).withColumn("quota", quotas(total, shards)), "plan")
    one = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    gaps = plan.withColumn("missing", F.greatest(F.lit(0), F.col("quota") - F.col("load"))).withColumn("from", F.coalesce(F.sum("missing").over(one), F.lit(0)))
    gaps = F.broadcast(gaps.filter("missing > 0").agg(F.array_sort(F.collect_list(F.struct("from", "shard"))).alias("gaps")))
    turn = ranked(labelled, ["shard", "linked"], ["uid"], many, "rank").join(F.broadcast(plan), "shard")
    position = F.when(F.col("linked"), F.col("rank")).otherwise(F.col("tied") + F.col("rank"))
    split = written(turn.select("uid", "shard", (position >= F.col("quota")).alias("over")), "split")
    over = ranked(split.filter("over").select("uid", F.lit(0).alias("all")), ["all"], ["uid"], many, "rank")
    moved = over.join(gaps).select("uid", F.element_at(F.filter("gaps", lambda g: g["from"] <= F.col("rank")), -1)["shard"].alias("shard"))
    final = written(split.filter("not over").select("uid", "shard").union(moved), "final")
    slots = ranked(final, ["shard"], ["uid"], many, "slot")
    out = written(rows.join(slots, "uid").select("doc_id", "size", "text_crc32", "shard", "slot"), "shards")
    dropped(rows, cells, state, labelled, plan, split, final)
    return out


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
