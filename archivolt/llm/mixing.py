"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums of sizes, a cut at
each source's exact budget, whole epochs before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.llm.ordered import before_blocks, in_blocks, word_count
from archivolt.llm.shared import dropped, table, written

WIDE = "decimal(38,0)"


def running(df: DataFrame, order: list, sums: list[str], name: str) -> DataFrame:
    """Adds b_<column>: the sum of the column over the rows before, in the order of all rows."""
    rows = in_blocks(df, order, name).withColumn("all", F.lit(0))
    spans = before_blocks(rows, ["all"], {c: F.sum for c in sums}).select("block", *[F.col(c).alias(f"s_{c}") for c in sums])
    earlier = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = [(F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.col(f"s_{c}")).alias(f"b_{c}") for c in sums]
    return rows.join(spans, "block").select(*df.columns, *within)


def targets(sources: DataFrame, weights: tuple, epochs: int) -> DataFrame:
    """sources(source, source_size) with `target`: the sum of all sizes shared by weight, where no source gets more than
    `epochs` times its size and what is over is shared again by weight.

    In the order of size by weight, a source is full exactly if its share of what the sources before leave is no less
    than it can give; so one prefix sum replaces the rounds of sharing."""
    counted = sources.withColumn("one", F.lit(1).cast("long"))
    numbered = running(counted, [F.asc_nulls_last("source")], ["one"], "sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("b_one") % len(weights) + 1).cast("int")).cast("long")
    weighed = written(numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("most")), "weighed")
    whole = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    ahead = running(weighed, [F.col("most") / F.col("weight"), F.asc_nulls_last("source")], ["most", "weight"], "levels")
    full = F.col("most").cast(WIDE) * (F.lit(whole[1]) - F.col("b_weight")) <= F.col("weight").cast(WIDE) * (F.lit(whole[0]) - F.col("b_most"))
    levels = written(ahead.select("source", "source_size", "weight", "most", full.alias("full")), "levels")
    rest = levels.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0))).first()
    share = ((F.lit(whole[0] - rest[0]) * F.col("weight")).cast("double") / F.lit(float(max(rest[1], 1))))
    return levels.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple = (1, 2, 3), epochs: int = 3, seed: str = "mix") -> DataFrame:
    """How much of every row of docs(doc_id, text, source) a mix of the size of all rows takes.

    Returns doc_id, source, size (words of the text; null: 0), source_size, target (words that the source should give)
    and taken (words that it gives, repeats counted).  Sources in order of code points, null last, have the weights in
    turn; a null source is one more source, apart from the empty one.  A source's budget is its target to the nearest
    word: whole epochs of all its rows, then rows in the order of md5(seed:doc_id) until the budget is spent, the last
    of them in part, so that the sum of taken is the budget.  No row gives more than `epochs` times its size.

    Ties in that order (repeated or null doc_ids) fall by size; rows equal in both are alike in the result but for the
    one that is cut.  Rows without words take nothing; texts of any length are counted whole; other columns are ignored;
    no rows give no rows.  The order depends on doc_id and seed alone, so reruns agree."""
    key = F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("uid")), "sized")
    order = [F.asc_nulls_last("source"), F.col("key"), F.col("doc_id"), F.col("size"), F.col("uid")]
    rows = in_blocks(sized.withColumn("key", key), order, "keyed")
    spans = written(before_blocks(rows, ["source"], {"size": F.sum}).withColumnRenamed("size", "ahead"), "spans")
    sources = targets(written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), weights, epochs)
    budget = F.floor(F.col("target") + 0.5)
    plan = sources.select(
        F.col("source").alias("of"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long").alias("whole"), budget.cast("long").alias("budget"),
    )
    spans = spans.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("of"), F.col("block").alias("at"), "ahead", "source_size", "target", "whole", (F.col("budget") - F.col("whole") * F.col("source_size")).alias("rest")
    )
    earlier = Window.partitionBy("block", "source").orderBy("key", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(spans, (F.col("block") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    before = F.col("ahead") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    out = placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
    dropped(sized)
    return out


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


MIXING_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5('mix:' || coalesce(doc_id::varchar, '')) k from documents),
s as (select source, sum(size)::bigint n, (row_number() over (order by source nulls last) - 1) % 3 + 1 w from d group by source),
o as (select *, 3 * n most, sum(n) over () t, sum(w) over () - coalesce(sum(w) over f, 0) rest, coalesce(sum(3 * n) over f, 0) given
      from s window f as (order by 3 * n / w, source nulls last rows between unbounded preceding and 1 preceding)),
c as (select *, most * rest <= w * (t - given) "full" from o),
a as (select coalesce(sum(most) filter ("full"), 0) used, greatest(coalesce(sum(w) filter (not "full"), 0), 1) open from c),
p as (select source, n, case when "full" then most::double else ((t - used) * w)::double / open::double end target from c, a),
b as (select *, floor(target + 0.5)::bigint budget from p),
q as (select *, case when n > 0 then budget // n else 0 end whole from b)
select doc_id, size, n source_size, target,
       (whole * size + greatest(0, least(size, budget - whole * n - coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0))))::bigint taken
from d join q on d.source is not distinct from q.source"""
