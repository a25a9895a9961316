"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.decontamination import leaks
from archivolt.llm.exact_spans import without_repeats
from archivolt.llm.minhash import near_duplicates
from archivolt.llm.packing import pack
from archivolt.llm.shared import table, written
from archivolt.llm.toxicity import categories, toxicity
from archivolt.session import attach

#: All stages read these columns and no others, whatever else a table has; an empty table stays empty.  Texts of any
#: length are read whole.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row, written, so that a stage can decide by row whatever the doc_ids are."""
    return written(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def as_docs(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("doc_id"), "text")


def without_rows(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of numbered() that are (left_semi) or aren't (left_anti) among found(row)."""
    return rows.join(found.hint("shuffle_hash"), "row", how).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes for toxic go; null and empty texts get the base rate and so stay, equal
    texts share one verdict."""
    attach(spark)
    scored = toxicity(docs.select(COLUMNS), table(spark, sf_dir, "labels"), categories(), keep=COLUMNS)
    return scored.filter("p_toxic < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that share at least 0.8 of their five-word shingles, one with the least doc_id stays, a null only where
    all are null, and of rows with equal doc_ids the first read; rows without words (null, empty, white space) stay."""
    attach(spark)
    rows = numbered(docs)
    near = near_duplicates(as_docs(rows), size=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    kept = near.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first).select("first.row")
    return without_rows(rows, kept, "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under repeated strings of 200 bytes go; characters cut in two go as well, and documents left empty.  A null
    text becomes an empty one and stays, as do all that were empty; null and repeated doc_ids are kept."""
    attach(spark)
    cut = without_repeats(docs.select("doc_id", "text", "lang", "source"), extra="lang,source", decoded=True)
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go; others with their doc_id stay, and so do null and empty texts."""
    attach(spark)
    rows = numbered(docs)
    found = leaks(as_docs(rows), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct()
    return without_rows(rows, found, "left_anti")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens; a null or empty text is the end id alone."""
    import public_tokenizers

    attach(spark)
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_tokens),
]

#: SQL cannot express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(attach(spark), sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
