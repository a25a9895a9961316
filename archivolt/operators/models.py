"""Models behind protocols, with deterministic stand-ins that need no weights."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from archivolt.functions.grammar import fold_text
from archivolt.functions.json_repair import first_object, whole_pairs


class Encoder(Protocol):
    name: str
    dimension: int

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray: ...


class HashedWords:
    """Unit vectors of hashed words."""

    name = "hashed-words"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            for word in fold_text(text or "").split():
                h = zlib.crc32(word.encode())
                out[i, h % self.dimension] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def overlap(query: str, texts: list[str]) -> list[float]:
    """The share of the query's words that each text has: a stand-in for a cross-encoder."""
    asked = set(fold_text(query or "").split())
    return [len(asked & set(fold_text(t or "").split())) / len(asked) if asked else 0.0 for t in texts]


def embedded(texts: DataFrame, make: Callable[[], Encoder], is_query: bool = False) -> DataFrame:
    """Adds vec to texts(text); the encoder is made once for each Python worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(list(model.encode(batch.fillna("").tolist(), is_query)))

    return texts.withColumn("vec", encode("text"))


def reranked(pairs: DataFrame, score: Callable[[str, list[str]], list[float]] = overlap) -> DataFrame:
    """Adds rerank (5 decimals) to pairs(question, text).  The model gets all texts of a question in a batch at once."""

    @F.pandas_udf(T.DoubleType())
    def rate(questions: pd.Series, texts: pd.Series) -> pd.Series:
        asked: dict = defaultdict(list)
        for i, question in enumerate(questions):
            asked[question].append(i)
        out = np.zeros(len(questions))
        for question, rows in asked.items():
            out[rows] = score(question, texts.iloc[rows].tolist())
        return pd.Series([round(float(x), 5) for x in out], dtype=float)

    return pairs.withColumn("rerank", rate("question", "text"))


def extractive_answers(items: DataFrame) -> DataFrame:
    """A stand-in for a decoder: the first evidence passage as the answer to items(id, evidence: array of texts)."""
    return items.select("id", F.coalesce(F.try_element_at("evidence", F.lit(1)), F.lit("")).alias("respuesta"), (F.size("evidence") == 0).alias("abstencion"))


def prefixed(text, is_query: bool, encoder: str):
    """Texts as an encoder wants them: one family tells questions from passages by a prefix."""
    return F.concat(F.lit("query: " if is_query else "passage: "), text) if "e5" in encoder.lower() else text


def option_query(question, option, rare=None):
    """The text an option is searched with: the option and some rare words of the question, or the question and it."""
    option = F.trim(option)
    return F.concat_ws(" ", F.trim(question), option) if rare is None else F.concat_ws(" ", option, F.array_join(rare, " "))


def fallback_option(options: DataFrame) -> DataFrame:
    """id and option of options(id, option, score) where no answer is usable: the best score, the first by name of equal
    ones and where no score exists."""
    best = F.max("score").over(Window.partitionBy("id"))
    top = options.withColumn("best", best).filter(F.col("best").isNull() | (F.col("score") == F.col("best")))
    return top.groupBy("id").agg(F.min("option").alias("option"))


CORRECTION = "\n\nLa salida anterior no era un JSON completo. Devuelve solo el objeto."


def generated(requests: DataFrame, generate: Callable[[str], tuple[str, bool]], cache: DataFrame | None = None) -> DataFrame:
    """id, key, answer (JSON or null) and tries (0: from the cache) of requests(id, key, prompt).

    generate gives a text and whether it was cut off.  What is no object is asked for once more with a correction,
    unless it was cut; of a cut one the whole pairs count.  cache(key, answer) is looked up first."""

    @F.pandas_udf("answer string, tries int")
    def answer(prompts: pd.Series) -> pd.DataFrame:
        rows = []
        for prompt in prompts:
            text, cut = generate(prompt)
            found, tries = first_object(text), 1
            if found is None and not cut:
                text, cut = generate(prompt + CORRECTION)
                found, tries = first_object(text), 2
            found = whole_pairs(text) if found is None and cut else found
            rows.append((None if found is None else json.dumps(found, ensure_ascii=False), tries))
        return pd.DataFrame(rows, columns=["answer", "tries"])

    if cache is None:
        return requests.select("id", "key", answer("prompt").alias("a")).select("id", "key", "a.answer", "a.tries")
    kept = cache.select("key", "answer").dropDuplicates(["key"])
    fresh = requests.join(kept, "key", "left_anti").select("id", "key", answer("prompt").alias("a")).select("id", "key", "a.answer", "a.tries")
    return requests.join(kept, "key").select("id", "key", "answer", F.lit(0).alias("tries")).union(fresh)
