"""A guard against question banks in a corpus: shared word n-grams between questions, answers and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions.text import ngrams, tokens

# N-gram length, least shared question n-grams, least share of the answer's, and marked characters.
GRAM, LEAST, ANSWER_SHARE, ITEMS, MARKED = 8, 3, 0.5, 3, 20_000


def grams(texts: DataFrame, n: int = GRAM) -> DataFrame:
    words = texts.select("id", tokens(F.col("text")).alias("words"))  # once a text, not once a gram
    return words.select("id", F.explode(ngrams(F.col("words"), n)).alias("gram"))


def shared_grams(questions: DataFrame, chunks: DataFrame, n: int = GRAM) -> DataFrame:
    """question_id, chunk_id, shared: distinct n-grams that both hold.  Chunk n-grams that no question has go before
    anything is counted."""
    asked = grams(questions, n).withColumnRenamed("id", "question_id")
    held = grams(chunks, n).withColumnRenamed("id", "chunk_id").join(asked.select("gram").distinct(), "gram", "left_semi")
    return asked.join(held, "gram").groupBy("question_id", "chunk_id").agg(F.count(F.lit(1)).alias("shared"))


def severity(questions: DataFrame, answers: DataFrame, chunks: DataFrame, n: int = GRAM) -> DataFrame:
    """chunk_id, severity, questions: grave where an item's question shares LEAST n-grams and ANSWER_SHARE of its
    answer's, or where ITEMS items hit the chunk; else review."""
    asked = shared_grams(questions, chunks, n)
    answered = shared_grams(answers, chunks, n).withColumnRenamed("shared", "shared_answer")
    sizes = grams(answers, n).groupBy(F.col("id").alias("question_id")).agg(F.count(F.lit(1)).alias("answer_grams"))
    both = asked.join(answered, ["question_id", "chunk_id"], "left").join(sizes, "question_id", "left")
    copied = (F.col("shared") >= LEAST) & (F.col("answer_grams") > 0) & (F.coalesce("shared_answer", F.lit(0)) >= ANSWER_SHARE * F.col("answer_grams"))
    by_chunk = both.groupBy("chunk_id").agg(F.max(F.coalesce(copied, F.lit(False))).alias("copied"), F.array_sort(F.collect_set("question_id")).alias("questions"))
    return by_chunk.select("chunk_id", F.when(F.col("copied") | (F.size("questions") >= ITEMS), "grave").otherwise("review").alias("severity"), "questions")


def bank_files(files: DataFrame, markers: list[str], exempt: str = "fuentes.csv") -> DataFrame:
    """Files(path, text) of json, jsonl, csv or txt that hold a marker within their first MARKED characters."""
    head = F.substring("text", 1, MARKED)
    hit = reduce(lambda a, b: a | b, [head.contains(m) for m in markers])
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(kind.isin("json", "jsonl", "csv", "txt") & ~F.col("path").endswith(exempt) & hit)


def guard(severities: DataFrame) -> None:
    """Raises before anything is indexed if a chunk is grave."""
    worst = [r["chunk_id"] for r in severities.filter("severity = 'grave'").limit(10).collect()]
    if worst:
        raise ValueError(f"chunks that copy the question bank: {worst}")
