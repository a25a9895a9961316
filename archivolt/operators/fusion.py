"""Fusion of rankings, boosts, diversity caps and quotas, for whole batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Fixed values of the ranking policy.
#: Kinds of documents that count as norms.
NORM_KINDS = ("constitucion", "codigo", "ley", "decreto", "decreto_ley", "acto_legislativo", "decision_andina", "resolucion", "circular")
RRF_K, PER_UNIT, PER_DOCUMENT, QUOTA, TOP_K = 60, 3, 4, 4, 10
BOOST_AREA, BOOST_BODY = 0.002, 0.01


def reciprocal_rank_fusion(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, id, rrf (8 decimals), origins and the best score of each origin, from rankings(query_id, id, origin,
    rank from 1, score, weight)."""
    part = F.col("weight") / (F.lit(k) + F.col("rank"))
    return rankings.groupBy("query_id", "id").agg(
        F.round(F.sum(part), 8).alias("rrf"),
        F.array_sort(F.collect_set("origin")).alias("origins"),
        F.max(F.when(F.col("origin") == "dense", F.col("score"))).alias("dense_score"),
        F.max(F.when(F.col("origin") == "bm25", F.col("score"))).alias("bm25_score"),
    )


def boosted(fused: DataFrame, area_matches, body_matches) -> DataFrame:
    add = F.when(area_matches, BOOST_AREA).otherwise(0.0) + F.when(body_matches, BOOST_BODY).otherwise(0.0)
    return fused.withColumn("rrf", F.col("rrf") + add)


def positions(candidates: DataFrame, score: str = "rrf") -> DataFrame:
    """Adds pos (from 1) by (tier, score desc, id); without a tier all are one."""
    tier = [F.col("tier")] if "tier" in candidates.columns else []
    return candidates.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*tier, F.desc(score), "id")))


def diversity_caps(candidates: DataFrame, per_unit: int = PER_UNIT, per_document: int = PER_DOCUMENT, complementary: int = 0) -> DataFrame:
    """Keeps candidates(query_id, pos, doc, unit, mentioned, complementary) in order while their unit, document and
    the complementary documents have room; mentioned documents are exempt from the last two.

    A row that one cap rejects is never counted by another, and each cap's exemption is a property of the document, so
    filtering by one rank after the other over what is left gives what one greedy pass would."""
    def turn(*keys):
        return F.row_number().over(Window.partitionBy("query_id", *keys).orderBy("pos"))

    kept = candidates.withColumn("_t", turn("doc", "unit")).filter(F.col("_t") <= per_unit)
    if per_document:
        kept = kept.withColumn("_t", turn("doc")).filter(F.col("mentioned") | (F.col("_t") <= per_document))
    if complementary:
        counted = (F.col("complementary") & ~F.col("mentioned")).cast("int")
        kept = kept.withColumn("_t", F.sum(counted).over(Window.partitionBy("query_id").orderBy("pos"))).filter((counted == 0) | (F.col("_t") <= complementary))
    return kept.drop("_t")


def is_norm(kind):
    return F.coalesce(kind.isin(*NORM_KINDS), F.lit(False))


def with_complementary(candidates: DataFrame, listed: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds complementary: whether a candidate's document is in listed(value)."""
    marks = listed.select(F.col("value").alias(doc), F.lit(True).alias("complementary")).distinct()
    return candidates.join(marks, doc, "left").withColumn("complementary", F.coalesce("complementary", F.lit(False)))


def quota_for(k: int, quota: int = QUOTA, top_k: int = TOP_K) -> int:
    return min(k, round(quota * k / top_k)) if quota and top_k else 0


def with_quota(kept: DataFrame, k: int = TOP_K, quota: int = QUOTA, norm: str = "is_norm") -> DataFrame:
    """The first k of kept(query_id, pos, is_norm), where the best norms behind them replace the last that are none
    until there are `quota` norms; at most 3k candidates are looked at.  Adds place (from 1)."""
    query = Window.partitionBy("query_id")
    looked = kept.withColumn("_p", F.row_number().over(query.orderBy("pos"))).filter(F.col("_p") <= 3 * k)
    head = F.col("_p") <= k
    is_norm = F.col(norm)
    ranked = (
        looked.withColumn("_norms", F.sum((head & is_norm).cast("int")).over(query))
        .withColumn("_others", F.sum((head & ~is_norm).cast("int")).over(query))
        .withColumn("_tail", F.sum((~head & is_norm).cast("int")).over(query))
        .withColumn("_swap", F.greatest(F.lit(0), F.least(F.lit(quota) - F.col("_norms"), F.col("_tail"), F.col("_others"))))
        .withColumn("_in", F.sum((~head & is_norm).cast("int")).over(query.orderBy("_p")))
        .withColumn("_out", F.sum((head & ~is_norm).cast("int")).over(query.orderBy(F.desc("_p"))))
    )
    chosen = ranked.filter((head & (is_norm | (F.col("_out") > F.col("_swap")))) | (~head & is_norm & (F.col("_in") <= F.col("_swap"))))
    return chosen.withColumn("place", F.row_number().over(query.orderBy("_p"))).drop("_p", "_norms", "_others", "_tail", "_swap", "_in", "_out")


def two_phase(candidates: DataFrame, n: int = 20) -> DataFrame:
    """Orders direct hits, then the n best fused by their new score, then the rest as they were: tier and final."""
    query = Window.partitionBy("query_id")
    placed = candidates.withColumn("_p", F.row_number().over(query.orderBy("direct", F.desc("rrf"), "id")))
    tier = F.when(F.col("direct"), 0).when(F.col("_p") <= n, 1).otherwise(2)
    final = F.when(F.col("direct"), 1 + F.col("rerank")).when(F.col("_p") <= n, F.round("rerank", 5)).otherwise(F.col("rrf") * 1e-3)
    return positions(placed.withColumn("tier", tier).withColumn("final", final), "final").drop("_p")


def slotted(question: DataFrame, options: DataFrame, k: int = TOP_K, from_question: int = 4, per_option: int = 2, per_document: int = 0, complementary: int = 0) -> DataFrame:
    """Places passages of a question and of its options: the question's best first, then in rounds the best of each option
    in turn that may still come in, and the question's rest.

    question(query_id, id, pos) and options(query_id, letter, id, pos) may have doc, mentioned, complementary and is_norm:
    a passage comes in once, while its document (unless mentioned) and the complementary ones have room, and the first
    places keep their part of the quota of norms.  Lists are cut to what can be placed (k, and per_option + 2 of an
    option) before they meet; a query is then one fold over its turns, each a list of candidates."""
    fields = {"doc": F.lit(None).cast("string"), "mentioned": F.lit(False), "complementary": F.lit(False), "is_norm": F.lit(False)}

    def cut(found: DataFrame, keys: list[str], most: int) -> DataFrame:
        for name, default in fields.items():
            found = found if name in found.columns else found.withColumn(name, default)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
        return found.withColumn("pos", rank).filter(F.col("pos") <= most)

    base, rounds = cut(question, ["query_id"], k), per_option + 2
    head = with_quota(base, min(from_question, k), quota_for(min(from_question, k), top_k=k)).select("query_id", "id", "place")
    by = cut(options, ["query_id", "letter"], rounds)
    item = lambda origin: F.struct("id", F.lit(origin).alias("origin") if isinstance(origin, str) else origin.alias("origin"), "doc", "mentioned", (F.col("complementary") & ~F.col("mentioned")).alias("counted"))
    in_order = lambda found: F.transform(F.array_sort(F.collect_list(found)), lambda x: x["item"])
    main = base.join(head, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", item("question").alias("item"))))), lambda x: F.array(x["item"])).alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", item("question").alias("item")))), lambda x: F.array(x["item"])).alias("rest"),
    )
    lists = by.groupBy("query_id", "letter").agg(in_order(F.struct("pos", item(F.col("letter")).alias("item"))).alias("list"))
    turn = lists.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("letter", "list"))), lambda x: x["list"]).alias("round"))
    both = main.join(turn, "query_id", "full")
    none = F.array().cast(both.schema["rest"].dataType)
    turns = F.concat(F.coalesce("first", none), F.flatten(F.array_repeat(F.coalesce("round", none), rounds)), F.coalesce("rest", none))

    def comes_in(taken, c):
        fresh = ~F.exists(taken, lambda x: x["id"] == c["id"])
        room = F.lit(True) if not per_document else c["mentioned"] | c["doc"].isNull() | (F.size(F.filter(taken, lambda x: x["doc"] == c["doc"])) < per_document)
        few = F.lit(True) if not complementary else ~c["counted"] | (F.size(F.filter(taken, lambda x: x["counted"])) < complementary)
        return fresh & room & few

    def step(taken, candidates):
        return F.when(F.size(taken) >= k, taken).otherwise(F.concat(taken, F.slice(F.filter(candidates, lambda c: comes_in(taken, c)), 1, 1)))

    start = F.array().cast(both.schema["rest"].dataType.elementType)
    placed = both.select("query_id", F.posexplode(F.aggregate(turns, start, step)).alias("at", "p"))
    return placed.select("query_id", (F.col("at") + 1).alias("place"), F.col("p.id").alias("id"), F.col("p.origin").alias("origin"))


def fitted(passages: DataFrame, fixed: Column, window: int, reserve: int, margin: int = 32, most: int = TOP_K) -> DataFrame:
    """The first of passages(query_id, pos, tokens) that fit a model's window beside `fixed` tokens of the prompt, `reserve`
    for its output and a margin; at most `most`.  The last go first, so what does not fit takes all behind it along."""
    order = Window.partitionBy("query_id").orderBy("pos")
    used = F.sum("tokens").over(order)
    placed = passages.withColumn("used", used.cast("long")).withColumn("_n", F.row_number().over(order))
    return placed.filter((F.col("_n") <= most) & (fixed + F.col("used") <= window - reserve - margin)).drop("_n")
