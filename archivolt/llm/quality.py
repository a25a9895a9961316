"""Text quality by voting of the nearest labelled texts.

A text's terms are the triples of character classes along its bytes, and words that follow themselves.  Square roots
of their shares, weighted by inverse document frequency, are projected on the leading singular vectors of a bounded
sample of labelled texts: latent-semantic vectors.  The sample's vectors go to all tasks; each task multiplies its
texts' vectors with all of them, block by block, and the nearest vote with their labels, weighted by similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.shared import slices, table, texts_of, words_of

SAMPLE = 4000  # labelled texts that are fitted on and vote, at most
LATENT, NEIGHBOURS, SHARPNESS = 48, 15, 16
STEPS = 1 << 20  # of a cosine
ROWS = 1024  # texts whose terms are held at once
CLASSES = 16
TERMS = CLASSES**3 + 1  # the last is the word that follows itself


def classes() -> np.ndarray:
    """The class of each byte: bytes over 127 count as lower-case letters."""
    out = np.full(256, 15, np.int32)
    groups = ["", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",", "!", "?", "$#%&*@^~+=", "|\t", "-_", "\"'`()[]{}<>", ":;/\\"]
    for k, chars in enumerate(groups):
        out[[ord(c) for c in chars]] = k
    out[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 0
    return out


CLASS = classes()


def shares(texts: pa.Array) -> np.ndarray:
    """Square roots of the terms' shares, a row for each whole text; without bytes all 0."""
    data, offsets = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    out = np.zeros((len(texts), TERMS), np.float32)
    size = np.diff(offsets)
    if len(data) >= 3:
        c = CLASS[data]
        code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        text = np.repeat(np.arange(len(texts)), size)
        inside = text[:-2] == text[2:]
        cell = text[:-2][inside] * TERMS + code[inside]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
    out /= np.maximum(size - 2, 1)[:, None]
    words, index, at = words_of(texts)
    again = np.zeros(len(index), bool)
    again[1:] = index[1:] == index[:-1]
    n = np.diff(at)
    again[at[:-1][n > 0]] = False
    out[:, -1] = np.bincount(np.repeat(np.arange(len(texts)), n)[again], minlength=len(texts)) / np.maximum(n, 1)
    return np.sqrt(out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projection (terms by latent dimensions, idf within), the sample's unit vectors, and their labels.

    labels(doc_id, y); at most SAMPLE ids are used, the least by a hash of doc_id, each with the least of its labels and
    with one of its texts.  Their terms come to the driver as bounded sparse rows."""
    sample = labels.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def terms(batches):
        for batch in slices(batches, 1 << 20, ROWS):
            x = shares(texts_of(batch.column("text")))
            rows = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([x[i, r].tobytes() for i, r in enumerate(rows)], pa.binary())],
                names=["doc_id", "y", "at", "value"],
            )

    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    found = texts.select("doc_id", "y", "t.text").mapInArrow(terms, "doc_id long, y int, at binary, value binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["at"], r["value"]))
    x = np.zeros((len(found), TERMS), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
    y = np.array([r["y"] for r in found], np.float64)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = unit(x * idf)
    # leading right singular vectors by subspace iteration
    basis = np.random.default_rng(3).standard_normal((TERMS, LATENT)).astype(np.float32)
    for _ in range(8 if len(x) else 0):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    return idf[:, None] * basis, unit(x @ basis), y


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs(doc_id, text); labels(doc_id, y) holds y in 0 and 1.

    A null or empty text has no terms and gets the sample's share of label 1, as do all texts where there are no
    labels (0.5 then); texts of any length are read whole; repeated rows are scored each; null doc_ids are scored but
    never fitted on; no rows give no rows; other columns are ignored.  Of labels that contradict each other the least
    counts, of different texts with one doc_id the one with the least hash.  Of neighbours that are as near as
    the last place, the first of the sample vote.  Cosines are taken in double precision and rounded to whole
    2**-20 before they are compared, so a score depends on the text and the labelled sample, not on the texts beside it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    projection, known, y = fit(docs, labels)
    base = float(y.mean()) if len(y) else 0.5
    shared = docs.sparkSession.sparkContext.broadcast((projection.astype(np.float64), known.astype(np.float64), y))

    def score(batches):
        projection, known, y = shared.value
        k, turn = min(NEIGHBOURS, len(y)), np.arange(len(y))[::-1]
        for batch in slices(batches, 1 << 20, ROWS):
            vectors = unit(shares(texts_of(batch.column("text"))).astype(np.float64) @ projection)
            out = np.full(batch.num_rows, base)
            for a in range(0, batch.num_rows if k else 0, 256):
                # whole steps of the cosine, and the sample's turn among equal ones, in one number
                near = np.rint(vectors[a : a + 256] @ known.T * STEPS).astype(np.int64) * len(y) + turn
                top = -np.sort(-np.partition(near, len(y) - k, axis=1)[:, len(y) - k :], axis=1)
                weight = np.maximum(top // len(y) / STEPS, 0) ** SHARPNESS
                label = y[len(y) - 1 - top % len(y)]
                out[a : a + 256] = ((weight * label).sum(axis=1) + 1e-6 * base) / (weight.sum(axis=1) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.mapInArrow(score, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").cast("int").alias("y"))
    found = quality(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
