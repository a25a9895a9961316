"""Exact dense search for a batch of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.operators.lexical import top

#: Bytes of the vectors on either side of a cell, and queries whose products are held at a time.
CELL_BYTES, STRIPE = 32 << 20, 64


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a):
    return F.sqrt(dot(a, a))


def sigmoid(x):
    return 1 / (1 + F.exp(-x))


def rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(x) * 10**decimals + 0.5), x) / 10**decimals


def closest_option(answers: DataFrame, options: DataFrame) -> DataFrame:
    """id, option and cosine (6 decimals): of options(id, option, vec) the one most similar to answers(id, vec), the
    first by name of equal ones."""
    both = answers.select("id", F.col("vec").alias("answer")).join(options, "id")
    cosine = F.round(dot(F.col("answer"), F.col("vec")) / (norm(F.col("answer")) * norm(F.col("vec"))), 6)
    best = both.select("id", "option", cosine.alias("cosine")).groupBy("id").agg(F.max("cosine").alias("top"), F.collect_list(F.struct("cosine", "option")).alias("all"))
    first = F.array_min(F.transform(F.filter("all", lambda o: o["cosine"] == F.col("top")), lambda o: o["option"]))
    return best.select("id", first.alias("option"), F.col("top").alias("cosine"))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, decimals: int = 5, cell_bytes: int | None = None) -> DataFrame:
    """query_id, rank, id, score: the k best inner products of each of queries(query_id, vec) over vectors(id, vec), by the
    product, then in the order of the rounded score and id.

    Queries are dealt to rows of a grid and vectors to its columns; each cell, where a part of bounded size of either
    meets, multiplies them and gives the k best of each query, which are merged.  Queries and vectors are both read
    once, and neither needs to fit anywhere.  Null vectors take no part; all others must have one length."""
    one = queries.filter("vec is not null").select(F.size("vec").alias("d")).first()
    d = one["d"] if one else 0
    of_rows, of_columns = (int(t.count() * max(d, 1) * 8 // (cell_bytes or CELL_BYTES)) + 1 for t in (queries, vectors))
    # equal ids must not meet in one cell more than others, so a row's number counts too
    deal = lambda key, parts: F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    copies = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = queries.filter("vec is not null").select("query_id", "vec", deal("query_id", of_rows).alias("r")).withColumn("c", copies(of_columns))
    held = vectors.filter("vec is not null").select("id", "vec", deal("id", of_columns).alias("c")).withColumn("r", copies(of_rows))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, raw double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of each query in a cell."""
        q, v = (matrix(t.column("vec")) for t in (left, right))
        ids, own = left.column("query_id").combine_chunks(), right.column("id").combine_chunks()
        order = np.argsort(pc.rank(own, sort_keys="ascending", tiebreaker="first").to_numpy(), kind="stable")
        own, v = own.take(pa.array(order)), v[order]  # by id, so that a stable sort gives ties to the smaller
        of, at, raw = [], [], []
        for begin in range(0, len(q) if len(v) else 0, STRIPE):
            every = rounded(q[begin : begin + STRIPE] @ v.T, decimals + 3)
            for j, scores in enumerate(every):
                best = np.arange(len(own)) if len(own) <= k else np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
                best = best[np.argsort(-scores[best], kind="stable")][:k]
                of.append(np.full(len(best), begin + j)), at.append(best), raw.append(scores[best])
        of, at, raw = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (of, at, raw))
        return pa.table({"query_id": ids.take(pa.array(of.astype(np.int64))), "id": own.take(pa.array(at.astype(np.int64))), "raw": pa.array(raw.astype(float))})

    found = asked.groupBy("r", "c").cogroup(held.groupBy("r", "c")).applyInArrow(score, schema)
    cut = Window.partitionBy("query_id").orderBy(F.desc("raw"), "id")
    kept = found.withColumn("turn", F.row_number().over(cut)).filter(F.col("turn") <= k)
    return top(kept.select("query_id", "id", F.round("raw", decimals).alias("score")), k)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = pc.list_flatten(column).to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
