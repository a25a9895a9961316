"""Scoring of answers: accuracy, citations, selective prediction, retrieval, latency and reproducibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions.grammar import bodies_of, extract_citations
from archivolt.operators.runs import placed

# Points of the components and the rules' weights.
POINTS = {"closed": 20.0, "judge": 30.0, "citations": 20.0, "abstention": 10.0}
UNSUPPORTED_HIT, UNSUPPORTED_PENALTY, ABSTAINED, EVIDENCE = 0.5, 2.0, 0.5, 10


def answer_text(for_judge: bool = False):
    """The text of an answer that citations are read from; the judge's variant leaves references out."""
    full = lambda *names: F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names])
    semi = full("respuesta") if for_judge else full("respuesta", "referencia_legal")
    return F.when(F.col("formato") == "multiple_choice", F.coalesce("justificacion", F.lit(""))).when(F.col("formato") == "semi_open", semi).otherwise(full("marco_normativo", "analisis", "jurisprudencia", "conclusion"))


def closed_accuracy(key: DataFrame, answers: DataFrame, flawed: tuple = ()) -> DataFrame:
    """n, hits, accuracy and points of key(id, expected) against answers(id, given, abstained); missing ones fail."""
    scored = key.filter(~F.col("id").isin(*flawed)) if flawed else key
    hit = ~F.coalesce("abstained", F.lit(False)) & (F.col("given") == F.col("expected"))
    both = scored.join(answers, "id", "left").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(hit, F.lit(False)).cast("int")).alias("hits"))
    accuracy = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    return both.select("n", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(accuracy, 6).alias("accuracy"), F.round(POINTS["closed"] * accuracy, 2).alias("points"))


def evidence_bodies(passages: DataFrame) -> DataFrame:
    """id, supported: body keys in the first EVIDENCE passages(id, pos, text)."""
    seen = passages.filter(F.col("pos") <= EVIDENCE).select("id", F.explode(bodies_of(extract_citations("text"))).alias("body"))
    return seen.groupBy("id").agg(F.array_sort(F.collect_set("body")).alias("supported"))


def citation_counts(answers: DataFrame) -> DataFrame:
    """Adds the counts of cited, reference and supported (arrays of body keys) to answers."""
    none = F.array().cast("array<string>")
    cited, ref, sup = (F.coalesce(c, none) for c in ("cited", "reference", "supported"))
    hits, outside = F.array_intersect(cited, ref), F.array_except(cited, ref)
    unsupported = F.array_except(outside, sup)
    return answers.select(
        "*", F.size(ref).alias("n_ref"), F.size(cited).alias("n_cited"), F.size(hits).alias("hits"),
        F.size(F.array_intersect(hits, sup)).alias("hits_supported"), F.size(F.array_except(hits, sup)).alias("hits_unsupported"),
        (F.size(outside) - F.size(unsupported)).alias("wrong"), F.size(unsupported).alias("unsupported"),
    )


COUNTS = ("n_ref", "n_cited", "hits", "hits_supported", "hits_unsupported", "wrong", "unsupported")


def citation_index(key: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: items, sums of the counts, weighted recall, rate of unsupported citations, index and points.  Items
    without a reference body are left out; missing and abstained answers only add their references."""
    none = F.array().cast("array<string>")
    answered = F.col("answered") & ~F.coalesce("abstained", F.lit(False))
    both = key.filter(F.size("reference") > 0).join(answers.withColumn("answered", F.lit(True)), "id", "left").withColumn("cited", F.when(answered, F.col("cited")).otherwise(none)).withColumn("supported", F.when(answered, F.col("supported")).otherwise(none))
    sums = citation_counts(both).agg(F.count(F.lit(1)).alias("items"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    recall = F.when(F.col("n_ref") > 0, (F.col("hits_supported") + UNSUPPORTED_HIT * F.col("hits_unsupported")) / F.col("n_ref")).otherwise(0.0)
    rate = F.when(F.col("n_cited") > 0, F.col("unsupported") / F.col("n_cited")).otherwise(0.0)
    index = F.greatest(F.lit(0.0), recall - UNSUPPORTED_PENALTY * rate)
    return sums.select("*", F.round(recall, 4).alias("recall"), F.round(rate, 4).alias("unsupported_rate"), F.round(index, 4).alias("index"), F.round(POINTS["citations"] * index, 2).alias("points"))


def selective_confusion(judged: DataFrame) -> DataFrame:
    """One row: tp, fp, tn, fn, calibration and points of judged(answered, abstained, right)."""
    answered, abstained, right = (F.coalesce(c, F.lit(False)) for c in ("answered", "abstained", "right"))
    label = F.when(~answered, "fn").when(abstained & ~right, "tp").when(abstained, "fp").when(right, "tn").otherwise("fn")
    n = judged.select(label.alias("label")).agg(*[F.coalesce(F.sum((F.col("label") == x).cast("int")), F.lit(0)).alias(x) for x in ("tp", "fp", "tn", "fn")], F.count(F.lit(1)).alias("items"))
    value = F.when(F.col("items") > 0, (F.col("tn") + ABSTAINED * (F.col("tp") + F.col("fp"))) / F.col("items")).otherwise(0.0)
    return n.select("*", F.round(value, 4).alias("calibration"), F.round(POINTS["abstention"] * value, 2).alias("points"))


def judge_mean(judged: DataFrame) -> DataFrame:
    """Mean of a judge's scores where failed ones are 0 and still count."""
    mean = F.when(F.count(F.lit(1)) > 0, F.sum(F.coalesce("score", F.lit(0.0))) / F.count(F.lit(1))).otherwise(0.0)
    return judged.agg(F.count(F.lit(1)).alias("n"), F.round(mean, 4).alias("correctness"), F.round(POINTS["judge"] * mean, 2).alias("points"))


def total_points(components: DataFrame) -> DataFrame:
    """Sum of the points that exist, and the most these components could give, of components(name, points)."""
    weight = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    return components.agg(F.round(F.sum("points"), 2).alias("total"), F.sum(F.when(F.col("points").isNotNull(), weight[F.col("name")])).alias("possible"))


def latency(times: DataFrame, group: list[str] | None = None) -> DataFrame:
    """n, mean, p50, p95 and max of times(seconds), by group or over all: the percentiles are values of the sorted list,
    not between them.  Ranks come from range partitions, so that not even all rows of one group meet in a task."""
    keys = list(group or [])
    sums = times.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean"), F.max("seconds").alias("max")).filter("n > 0")
    ranked = placed(times.select(*keys, "seconds"), "seconds", tuple(keys))
    wanted = sums.select(*[F.col(c).alias(f"_{c}") for c in keys], (F.floor(F.col("n") / 2) + 1).alias("i50"), (F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)) + 1).alias("i95"))
    same = [ranked[c].eqNullSafe(wanted[f"_{c}"]) for c in keys] + [(F.col("pos") == F.col("i50")) | (F.col("pos") == F.col("i95"))]
    at = lambda i: F.max(F.when(F.col("pos") == F.col(i), F.col("seconds")))
    found = ranked.join(F.broadcast(wanted), same).groupBy(*keys).agg(at("i50").alias("p50"), at("i95").alias("p95"))
    both = sums.alias("s").join(found.alias("f"), [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys] or F.lit(True))
    return both.select(*[F.col(f"s.{c}") for c in keys], "n", *[F.round(c, 2).alias(c) for c in ("mean", "p50", "p95", "max")])


def retrieval_quality(items: DataFrame) -> DataFrame:
    """By area and over all (area null): items, hit rate and body recall of items(area, reference, found)."""
    found = F.size(F.array_intersect("reference", "found"))
    judged = items.filter(F.size("reference") > 0).select("area", (found > 0).cast("int").alias("hit"), found.alias("found"), F.size("reference").alias("n_ref"))
    return judged.rollup("area").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("hit") / F.count(F.lit(1)), 6).alias("hit_rate"), F.round(F.sum("found") / F.sum("n_ref"), 6).alias("recall"))


def same_document_histogram(passages: DataFrame) -> DataFrame:
    """most, questions: how many questions have at most so many passages of one document."""
    return passages.groupBy("id", "doc").count().groupBy("id").agg(F.max("count").alias("most")).groupBy("most").agg(F.count(F.lit(1)).alias("questions"))


def reproduced(delivered: DataFrame, again: DataFrame, fields: list[str]) -> DataFrame:
    """id and, for each field, whether both runs agree; ids of one run only are left out."""
    both = delivered.alias("x").join(again.alias("y"), "id")
    return both.select("id", *[F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")).alias(f"same_{f}") for f in fields])


def relevance(passages: DataFrame) -> DataFrame:
    """id, relevance and its source: the best reranker score, else the best dense score, else none."""
    best = passages.groupBy("id").agg(F.max("score_rerank").alias("r"), F.max("score_dense").alias("d"))
    return best.select("id", F.coalesce("r", "d").alias("relevance"), F.when(F.col("r").isNotNull(), "rerank").when(F.col("d").isNotNull(), "dense").otherwise("none").alias("source"))


def abstention(answers: DataFrame, rerank_least: float = 0.025, dense_least: float = 0.35) -> DataFrame:
    """Adds abstain and reason: the first of the rules that holds."""
    reason = (
        F.when(F.col("failed"), "failed").when(F.col("source") == "none", "no_passages")
        .when((F.col("source") == "rerank") & (F.col("relevance") < rerank_least), "low_relevance").when((F.col("source") == "dense") & (F.col("relevance") < dense_least), "low_similarity")
        .when(F.col("model_abstains"), "model")
    )
    return answers.withColumn("reason", reason).withColumn("abstain", F.col("reason").isNotNull())
