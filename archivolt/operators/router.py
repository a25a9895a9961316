"""Passages by explicit citation, and what a question and its evidence have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.functions.grammar import body_key, extract_citations


def cited(texts: DataFrame) -> DataFrame:
    """id, turn, body and article of each citation of texts(id, text), in the order of their text form."""
    return texts.select("id", F.posexplode(extract_citations("text")).alias("turn", "c")).select("id", "turn", body_key(F.col("c.kind"), F.col("c.number"), F.col("c.year")).alias("body"), F.lower("c.article").alias("article"))


def routed(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, pos, id: chunks(id, body, article) of the articles that questions(id, text) cite, each once."""
    asked = cited(questions).filter("article is not null").withColumnRenamed("id", "query_id")
    held = chunks.filter("article is not null").select("id", "body", F.lower("article").alias("article"))
    hits = asked.join(held, ["body", "article"]).groupBy("query_id", "id").agg(F.min("turn").alias("turn"))
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "id"))).select("query_id", "pos", "id")


def mentioned(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, doc: documents(doc, body) whose body a question names."""
    return cited(questions).select(F.col("id").alias("query_id"), "body").distinct().join(documents, "body").select("query_id", "doc").distinct()


def supporting(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """id, body and the numbers of the passages(id, pos, text) that hold a body the answer names."""
    named = cited(answers).select("id", "body").distinct()
    held = passages.select("id", "pos", F.explode(extract_citations("text")).alias("c")).select("id", "pos", body_key(F.col("c.kind"), F.col("c.number"), F.col("c.year")).alias("body")).distinct()
    return named.join(held, ["id", "body"], "left").groupBy("id", "body").agg(F.array_sort(F.collect_set("pos")).alias("passages"))
