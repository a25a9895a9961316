"""Whitening of vectors: the leading eigenvectors of their covariance by block Lanczos, without the matrix.

Each pass over the vectors computes the centred product Xt(Xv)/n of a few directions: every task multiplies its rows and
sums, Spark adds the tasks' sums by dimension, and the driver orthogonalises d x block numbers.  Nothing that reaches the
driver grows with the number of vectors."""

from __future__ import annotations

from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.shared import dropped, table, written

SCALE, SHIFT = 64, 1_000_000
#: Directions of one pass, and columns that the basis may have before it is compressed to its best directions.
BLOCK, BASIS = 16, 512
#: Entries beyond this have no exact whole number.
LARGEST = 1 << 52
PASSES = 1000
#: Passes from fresh random directions that must leave converged pairs as they are.
CONFIRM = 8
ROWS = 1 << 14


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the entries as whole numbers, of the vectors that take part."""
    entries = F.col("embedding").cast("array<double>")
    fits = F.forall(entries, lambda c: F.coalesce(F.abs(c * SCALE) <= F.lit(float(LARGEST)), F.lit(False)))
    some = embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(fits)
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def matrices(batches, d: int):
    """Slices of record batches with x as rows of whole numbers."""
    for batch in batches:
        lists = batch.column("x")
        flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS), flat[at : at + ROWS]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, exact until the one division."""
    return (n * x - sums) / n if float(np.abs(x).max(initial=0)) * n < 2.0**62 else ((n * x.astype(object) - sums.astype(object)) / n).astype(np.float64)


def squares(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sum over dimensions of (n x - S)^2 of each row, exact, as decimals."""
    kind = pa.decimal128(38, 0)
    if float(np.abs(x).max(initial=0)) * n < 2.0**62:
        moved = n * x - sums
        if float(np.abs(moved).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return pa.array((moved * moved).sum(axis=1), pa.int64()).cast(pa.decimal128(19, 0)).cast(kind)
    moved = n * x.astype(object) - sums.astype(object)
    return pa.array([_decimal(int(v)) for v in (moved * moved).sum(axis=1)], kind)


def _decimal(v: int) -> Decimal | None:
    return Decimal(v) if abs(v) < 10**38 else None


def product(batches, d: int, n: int, sums: np.ndarray, vectors: np.ndarray):
    """This task's part of Xt(X vectors), one row a dimension."""
    total = np.zeros(vectors.shape)
    for _, x in matrices(batches, d):
        c = centred(x, n, sums)
        total += c.T @ (c @ vectors)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *[pa.array(np.ascontiguousarray(column)) for column in total.T]], ["i", *[f"c{j}" for j in range(vectors.shape[1])]])


def applied(x: DataFrame, d: int, n: int, sums: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """V times vectors: a pass over the rows."""
    names = [f"c{j}" for j in range(vectors.shape[1])]
    parts = x.select("x").mapInArrow(partial(product, d=d, n=n, sums=sums, vectors=vectors), "i int, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toPandas().sort_values("i")
    return found[names].to_numpy() / n


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, want: int) -> np.ndarray:
    """block made orthonormal and orthogonal to basis, twice; directions that vanish (a breakdown) are replaced by random
    ones while there is room for `want` columns."""
    d = block.shape[0]
    want = min(want, d - basis.shape[1])
    kept = np.zeros((d, 0))
    size = max(float(np.abs(block).max(initial=0)), np.finfo(float).tiny)
    tries = [*(block / size).T]
    while kept.shape[1] < want:
        v = tries.pop(0) if tries else rng.standard_normal(d)
        was = np.linalg.norm(v)
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            v = v - kept @ (kept.T @ v)
        if np.linalg.norm(v) > 1e-10 * max(was, 1e-10):
            v = v / np.linalg.norm(v)
            v = v - basis @ (basis.T @ v) - kept @ (kept.T @ v)
            kept = np.column_stack([kept, v / np.linalg.norm(v)])
    return kept


def leading(apply, d: int, k: int, block: int = BLOCK, basis: int = BASIS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, and unit eigenvectors of a symmetric operator of size d, known by apply(vectors).

    Block Lanczos with full reorthogonalisation: Ritz pairs of the whole basis, until their residuals, taken with the
    products at hand, are at rounding, or the basis is the whole space, where they are exact.  Residuals can't tell that
    an eigenvalue of a space wider than a block is missing copies, so converged pairs are confirmed: the basis grows from
    fresh random directions for CONFIRM passes, and the values must stay.  A basis of `basis` columns is compressed to its
    best k + block directions, and the next block goes on from the last residual."""
    k, rng = min(k, d), np.random.default_rng(seed)
    basis = max(basis, 2 * (k + block))
    held, images, found, left = np.zeros((d, 0)), np.zeros((d, 0)), None, 0
    nxt = orthonormal(rng.standard_normal((d, min(block, d))), held, rng, block)
    for _ in range(PASSES):
        image = apply(nxt)
        held, images = np.column_stack([held, nxt]), np.column_stack([images, image])
        projected = held.T @ images
        values, turns = np.linalg.eigh((projected + projected.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        top = turns[:, :k]
        residual = np.linalg.norm(images @ top - (held @ top) * values[:k], axis=0)
        if held.shape[1] >= d:
            return values[:k], held @ top
        rounding = max(d, 64) * np.finfo(float).eps * max(abs(values[0]), np.finfo(float).tiny)
        if held.shape[1] >= k and residual.max(initial=0) <= rounding:
            if found is None or np.abs(values[:k] - found).max() > 16 * rounding:
                found, left, image = values[:k], CONFIRM, rng.standard_normal(image.shape)
            elif left <= 0:
                return values[:k], held @ top
        left -= 1
        if held.shape[1] + block > basis:
            best = turns[:, : k + block]
            nxt = orthonormal(image, held, rng, block)
            held, images = held @ best, images @ best
            nxt = orthonormal(nxt, held, rng, block)
        else:
            nxt = orthonormal(image, held, rng, block)
    raise ArithmeticError(f"residuals of {residual.max()} after {PASSES} passes")


def sums_of(batches, d: int):
    total = np.zeros(d, object)
    for _, x in matrices(batches, d):
        total = total + (x.sum(axis=0) if float(np.abs(x).max(initial=0)) * len(x) < 2.0**62 else x.astype(object).sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([_decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["i", "s"])


def projections(batches, d: int, n: int, sums: np.ndarray, axes: np.ndarray):
    for batch, x in matrices(batches, d):
        z = centred(x, n, sums) @ axes
        ends = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), squares(x, n, sums), pa.ListArray.from_arrays(ends, pa.array(z.reshape(-1)))], ["vec_id", "deviation", "z"])


def moments(batches, k: int, mean: np.ndarray | None):
    """This task's sums of z, or of (z - mean)(z - mean)t."""
    total = np.zeros((k, 1 if mean is None else k))
    for batch in batches:
        z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        total += z.sum(axis=0)[:, None] if mean is None else (z - mean).T @ (z - mean)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], ["i", "s"])


def gathered(parts: DataFrame) -> np.ndarray:
    return parts.groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")["s"].to_numpy()


def whiten(embeddings: DataFrame, components: int = 32, block: int = BLOCK) -> DataFrame:
    """The vectors of embeddings(vec_id, embedding) on the leading components of their covariance, each with variance one.

    Entries become the whole numbers floor(64 c) + 1000000.  Returns, for each vector and component (numbered from 1 by
    falling eigenvalue), vec_id, component, n, deviation (decimal: the squared distance from the mean times n^2, exact),
    whitened, explained (the eigenvalue's share of the trace, which is the sum of deviations / n^3) and identity_error.

    Vectors take part unless they are null or empty, hold null, NaN or infinite entries or entries over 2^46, or have
    another length than most of them (the greater one where two are as frequent).  vec_id may be null or repeated; equal
    vectors count each.  Directions without variance (an eigenvalue under 1e-12 of d times the greatest) can't be whitened, so there are
    as many components as the vectors span, and no rows where they are all equal or there are none.  Of equal eigenvalues
    any basis of their space is taken.  Other columns are ignored."""
    read = written(whole_vectors(embeddings), "vectors", "zstd")
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    kinds = read.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    if kinds is None:
        return spark.createDataFrame([], schema)
    n, d = kinds["n"], kinds["d"]
    x = read.filter(F.size("x") == d)
    totals = x.select("x").mapInArrow(partial(sums_of, d=d), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    exact = [int(r["s"]) for r in totals]
    sums = np.array(exact, np.int64) if max(map(abs, exact)) < 2**62 else np.array(exact, object)
    values, axes = leading(lambda v: applied(x, d, n, sums, v), d, components, block)
    project = partial(projections, d=d, n=n, sums=sums)
    kept = values > 1e-12 * max(values.max(initial=0) * d, np.finfo(float).tiny)
    values, axes = values[kept], axes[:, kept]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    rows = written(x.mapInArrow(partial(project, axes=axes / np.sqrt(values)), "vec_id long, deviation decimal(38,0), z array<double>"), "whitened")
    trace = int(rows.agg(F.sum("deviation").alias("t")).first()["t"]) / n**3
    mean = gathered(rows.select("z").mapInArrow(partial(moments, k=k, mean=None), "i int, s double")) / n
    covariance = gathered(rows.select("z").mapInArrow(partial(moments, k=k, mean=mean), "i int, s double")).reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    out = rows.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
    dropped(read)
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations as long; null where one does not fit."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
