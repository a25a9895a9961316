"""Exact top-k by inner product over a pivot-distance index.

Vectors are made of whole numbers, floor(scale * x).  With one more coordinate, sqrt(M^2 - |v|^2) where M is the
greatest norm, the largest inner product is the least distance.  Every vector is keyed by its nearest pivot and its
distance to it; rings (annuli) of a pivot are cut into blocks of bounded size.  By the triangle inequality a ring holds
nothing nearer to a query than the gap between the query's distance to the pivot and the ring.  Queries near one pivot
come in packs of bounded size; a pack takes the rings in the order of the least of its queries' bounds, a growing number
of them at a time, and leaves out those that lie beyond the radius of the k-th score so far of all its queries, so the
result is exact and what is joined are packs and blocks, not queries and blocks.

Vectors with components too large for exact sums in floating point stand apart: all queries search them, and they as
queries search all, in Python's whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.llm.shared import dropped, table, written

SAMPLE = 4096  # vectors that pivots are taken from, at most
MOST_PIVOTS = 256
BLOCK_BYTES = 1 << 19  # of the components of about so many vectors that make a block
PACK_BYTES = 1 << 18  # and of the queries of a pack
RINGS = 24  # rings over the spread of distances in the sample; one more on each side takes what lies beyond
FIRST, GROWTH = 2, 16  # rings that a query takes first, and how their number grows
LONG = 2**63 - 1
FROM_KEY = 2**62  # scores from here on, which only whole-number products reach, carry a key of their exact value


def widest(d: int) -> float:
    """Components up to this have sums of d products below 2**52, exact in floating point."""
    return math.floor((2**52 / d) ** 0.5)


def slack(d: int, top: float) -> float:
    """More than the rounding of three distances between points of squared norm `top`: an error of 16 (d + 4) top
    units of 2**-53 in a square is at most its root in the distance."""
    return 3 * (16 * (d + 4) * max(top, 1.0) * 2.0**-53) ** 0.5


def whole(x: float, scale: int) -> int:
    """floor(scale * x) where the product may leave the range of floating point."""
    return math.floor(x * scale) if abs(x) < 2**40 else int(x) * scale


def key_of(score: int) -> bytes | None:
    """Bytes that sort like scores beyond FROM_KEY do."""
    if abs(score) < FROM_KEY:
        return None
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(2) + abs(score).to_bytes(size)
    return b"\x01" + raw if score > 0 else b"\x00" + bytes(255 - b for b in raw)


def by_kind(batches):
    """Batches of one dimension each, and of one sort of vectors: (d, wide, batch)."""
    for batch in batches:
        n = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
        wide = batch.column("wide").to_numpy(zero_copy_only=False)
        for d in np.unique(n).tolist():
            for w in (False, True):
                if ((n == d) & (wide == w)).any():
                    yield d, w, batch.filter(pa.array((n == d) & (wide == w)))


def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def packed(x: np.ndarray, wide: bool, scale: int) -> list[bytes]:
    """Whole numbers of 32 bits, or the components themselves where they are wide."""
    return [row.tobytes() for row in (x if wide else np.floor(scale * x).astype(np.int32))]


def unpacked(raw: bytes, d: int, wide: bool, scale: int) -> np.ndarray:
    if wide:
        return np.array([whole(v, scale) for v in np.frombuffer(raw, np.float64).tolist()], object).reshape(-1, d)
    return np.frombuffer(raw, np.int32).reshape(-1, d).astype(np.float64)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: as 64-bit numbers, or as Python's where either side is wide."""
    if q.dtype != object and v.dtype != object:
        return (q @ v.T).astype(np.int64)
    q, v = (x if x.dtype == object else np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape) for x in (q, v))
    return q @ v.T


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """n pivots: some rounds of Lloyd's algorithm from the sample's first rows."""
    centres = sample[:n].copy()
    for _ in range(6):
        d = (centres**2).sum(axis=1)[None] - 2 * sample @ centres.T
        own = d.argmin(axis=1)
        for k in np.unique(own).tolist():
            centres[k] = sample[own == k].mean(axis=0)
    return centres


def distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)[:, None] + (last**2)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * (x @ pivots[:, :-1].T + last[:, None] * pivots[:, -1][None])
    return np.sqrt(np.maximum(squares, 0))


def search(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best scores of each query among all other rows of vectors(vec_id, embedding), ties to the smaller vec_id.

    Returns query_id, rank (from 1), vec_id and score; scores beyond 64 bits rank by their exact value and are shown
    as the nearest number of 64 bits.  Rows whose vector is null, empty or holds null or non-finite components take no
    part; queries meet vectors of their own dimension; repeated rows are rows of their own, so one can find the other; a
    null vec_id sorts last among ties and is no query; fewer than k others give fewer rows; no rows give none; other
    columns are ignored.  For each dimension, pivots (MOST_PIVOTS, from SAMPLE vectors) and rings (RINGS + 2 a pivot)
    reach the driver, and no vector beyond the sample.  The result's _archivolt_searched tells how many pairs of a query
    and a ring were searched, and how many there are."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    greatest = F.array_max(F.transform("embedding", lambda v: F.abs(v)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(sound).withColumn("uid", F.monotonically_increasing_id())
    rows = written(rows.withColumn("wide", greatest * scale + 1 > F.floor(F.sqrt(F.lit(float(2**52)) / F.size("embedding")))), "vectors")
    schema_out = "query_id long, rank int, vec_id long, score long"
    norm = F.aggregate(F.transform("embedding", lambda v: F.floor(v * scale).cast("double")), F.lit(0.0), lambda a, v: a + v * v)
    kinds = rows.groupBy(F.size("embedding").alias("d")).agg(F.count_if(~F.col("wide")).alias("n"), F.max(F.when(~F.col("wide"), norm)).alias("m")).collect()
    if not kinds:
        dropped(rows)
        out = spark.createDataFrame([], schema_out)
        out._archivolt_searched = (0, 0)
        return out
    top = {r["d"]: float(r["m"] or 0) for r in kinds}
    pivots, width, begin = {}, {}, {}
    for r in kinds:
        d, n = r["d"], r["n"]
        if not n:
            continue
        taken = rows.filter((F.size("embedding") == d) & ~F.col("wide")).orderBy(F.xxhash64("uid")).limit(SAMPLE).select("embedding").collect()
        s = np.floor(scale * np.array([t[0] for t in taken], np.float64))
        s = np.concatenate([s, np.sqrt(np.maximum(top[d] - (s**2).sum(axis=1), 0))[:, None]], axis=1)
        s = np.unique(s, axis=0)
        s = s[np.random.default_rng(5).permutation(len(s))]
        pivots[d] = pivots_of(s, max(1, min(MOST_PIVOTS, len(s), int(n**0.5 / 8))))
        r_own = distances(s[:, :-1], s[:, -1], pivots[d]).min(axis=1)
        begin[d], width[d] = float(r_own.min()), max(1.0, float(r_own.max() - r_own.min()) / RINGS)

    def key(batches):
        for d, wide, batch in by_kind(batches):
            v, n = vectors_of(batch), batch.num_rows
            if wide:
                own, ring, r = np.full(n, -1), np.zeros(n), np.zeros(n)
            else:
                f = np.floor(scale * v)
                dist = distances(f, np.sqrt(np.maximum(top[d] - (f**2).sum(axis=1), 0)), pivots[d])
                own = dist.argmin(axis=1)
                r = dist[np.arange(n), own]
                ring = np.clip((r - begin[d]) // width[d], -1, RINGS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, d, np.int32)), pa.array(own.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(r), batch.column("uid"), batch.column("vec_id"), pa.array(packed(v, wide, scale), pa.binary())],
                names=["d", "pivot", "ring", "r", "uid", "vec_id", "v"],
            )

    keyed = written(rows.mapInArrow(key, "d int, pivot int, ring int, r double, uid long, vec_id long, v binary"), "keyed")
    sizes = written(keyed.groupBy("d", "pivot", "ring").agg(F.ceil(F.count(F.lit(1)) * F.col("d") * 4 / BLOCK_BYTES).cast("int").alias("parts"), F.min("r").alias("low"), F.max("r").alias("high")), "rings")
    edges: dict[int, tuple] = {}
    for d in top:
        mine = sorted((r["pivot"], r["ring"], r["low"], r["high"]) for r in sizes.filter(F.col("d") == d).collect())
        edges[d] = tuple(np.array([m[i] for m in mine]) for i in range(4))
    dealt = keyed.join(sizes.select("d", "pivot", "ring", "parts"), ["d", "pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("uid"), "parts").cast("int"))

    def block(batches):
        held, part = None, []

        def one():
            return {
                **dict(zip(("d", "pivot", "ring", "part"), held, strict=True)),
                "uids": np.array([p[4] for p in part], np.int64).tobytes(), "ids": np.array([LONG if p[5] is None else p[5] for p in part], np.int64).tobytes(),
                "nulls": np.array([p[5] is None for p in part], bool).tobytes(), "vs": b"".join(p[6] for p in part),
            }

        def batch_of(found):
            return pa.RecordBatch.from_pylist(found, schema=pa.schema([*((c, pa.int32()) for c in ("d", "pivot", "ring", "part")), *((c, pa.binary()) for c in ("uids", "ids", "nulls", "vs"))]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("d", "pivot", "ring", "part", "uid", "vec_id", "v")), strict=True):
                if row[:4] != held:
                    if part:
                        yield batch_of([one()])
                    held, part = row[:4], []
                part.append(row)
        if part:
            yield batch_of([one()])

    names = ["d", "pivot", "ring", "part"]
    blocks = written(dealt.repartition(*names).sortWithinPartitions(*names).select(*names, "uid", "vec_id", "v").mapInArrow(block, "d int, pivot int, ring int, part int, uids binary, ids binary, nulls binary, vs binary").withColumn("block", F.monotonically_increasing_id()), "blocks")

    def ask(batches):
        for d, wide, batch in by_kind(batches):
            q, n = vectors_of(batch), batch.num_rows
            qq, own = np.zeros(n), np.full(n, -1)
            if not wide:
                f = np.floor(scale * q)
                qq = (f**2).sum(axis=1)
                own = distances(f, np.zeros(n), pivots[d]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("vec_id"), pa.array(np.full(n, d, np.int32)), batch.column("wide"), pa.array(own.astype(np.int32)), pa.array(qq), pa.array(packed(q, wide, scale), pa.binary())],
                names=["uid", "query_id", "d", "wide", "own", "qq", "q"],
            )

    asked_rows = written(rows.filter("vec_id is not null").filter(is_query).mapInArrow(ask, "uid long, query_id long, d int, wide boolean, own int, qq double, q binary"), "asked")
    of_pivot = ["d", "wide", "own"]
    packs = asked_rows.groupBy(*of_pivot).agg(F.ceil(F.count(F.lit(1)) * F.col("d") * 4 / PACK_BYTES).alias("packs"))
    pack = F.xxhash64(*of_pivot, F.pmod(F.xxhash64("uid"), "packs"))
    queries = written(asked_rows.join(packs, of_pivot).withColumn("pack", pack).drop("own", "packs"), "queries")

    def expand(first: int, last: int | None):
        """The rings of each pack from its first-th to before its last-th, as far as they may hold something better."""

        def run(batches):
            for batch in batches:
                at_pack, at_pivot, at_ring, at_d, held = [], [], [], [], []
                for number, d, wide, asked in zip(*(batch.column(c).to_pylist() for c in ("pack", "d", "wide", "asked")), strict=True):
                    pivot, ring, low, high = edges[d]
                    near = np.zeros((len(asked), len(pivot)), bool)
                    if wide or d not in pivots:  # wide vectors may be anywhere, and wide queries search all
                        bound = np.zeros(near.shape)
                    else:
                        q = unpacked(b"".join(a["q"] for a in asked), d, False, scale)
                        at = distances(q, np.zeros(len(q)), pivots[d])[:, pivot]
                        bound = np.where(pivot < 0, 0, np.maximum(np.maximum(at - high, low - at), 0))
                    radius = np.array([math.inf if wide or a["least"] is None else math.sqrt(max(0.0, a["qq"] + top[d] - 2 * a["least"])) + slack(d, top[d]) for a in asked])
                    order = np.argsort(bound.min(axis=0), kind="stable")[first:last]
                    order = order[(bound[:, order] <= radius[:, None]).any(axis=0)]
                    at_pack += [number] * len(order)
                    at_d += [d] * len(order)
                    at_pivot += pivot[order].tolist()
                    at_ring += ring[order].tolist()
                    held += [len(asked)] * len(order)
                yield pa.RecordBatch.from_arrays([pa.array(at_pack, pa.int64()), pa.array(at_d, pa.int32()), pa.array(at_pivot, pa.int32()), pa.array(at_ring, pa.int32()), pa.array(held, pa.int64())], names=["pack", "d", "pivot", "ring", "held"])

        return run

    every = {d: len(e[0]) for d, e in edges.items()}
    best, searched, first, last = None, 0, 0, FIRST
    while first < max(every.values()):
        asking = queries.withColumn("least", F.lit(None).cast("long"))
        if best is not None:
            have = best.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
            asking = queries.join(have, "uid", "left").withColumn("least", F.when(F.col("n") >= k, F.col("least")))
        asking = written(asking.groupBy("pack", "d", "wide").agg(F.collect_list(F.struct("uid", "least", "qq", "q")).alias("asked")), "asking")
        asked = written(asking.mapInArrow(expand(first, last), "pack long, d int, pivot int, ring int, held long"), "asked")
        n = asked.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
        searched += n
        if n:
            pairs = asked.join(blocks.select("block", "d", "pivot", "ring"), ["d", "pivot", "ring"]).select("pack", "block")
            found = scored(pairs, asking, blocks, k, scale)
            fresh = written(best_of(found if best is None else best.union(found), k), "best")
            dropped(*([best] if best is not None else []))
            best = fresh
        dropped(asking, asked)
        if best is not None and not n and first:
            break
        first, last = last, last * GROWTH
    if best is None:
        out = spark.createDataFrame([], schema_out)
    else:
        turn = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.desc("key"), F.asc_nulls_last("vec_id")))
        out = written(best.withColumn("rank", turn).join(queries.select("uid", "query_id"), "uid").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top")
        dropped(best)
    asking_all = queries.groupBy("d").count().collect()
    out._archivolt_searched = (searched, sum(r["count"] * every[r["d"]] for r in asking_all))
    dropped(rows, keyed, sizes, blocks, asked_rows, queries)
    return out


def best_of(found: DataFrame, k: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.desc("key"), F.asc_nulls_last("vec_id")))
    return found.withColumn("turn", turn).filter(F.col("turn") <= k).drop("turn")


def scored(asks: DataFrame, queries: DataFrame, blocks: DataFrame, k: int, scale: int) -> DataFrame:
    """uid, vec_id, score and key (key_of the score): for each asked (pack, block) the k best of the block for each query of
    the pack that reach its `least`.

    A task multiplies a pack of queries with a block."""
    def exact(asked, q, v, uids, ids, nulls):
        for a, row in zip(asked, products(q, v).tolist(), strict=True):
            shown = [max(-LONG - 1, min(LONG, int(s))) for s in row]
            at = [i for i in range(len(row)) if uids[i] != a["uid"] and (a["least"] is None or shown[i] >= a["least"])]
            at.sort(key=lambda i: (-int(row[i]), nulls[i], ids[i]))  # noqa: B023
            yield from ((a["uid"], None if nulls[i] else int(ids[i]), shown[i], key_of(int(row[i]))) for i in at[:k])

    def quick(asked, q, v, uids, ids, nulls):
        for a, score in zip(asked, products(q, v), strict=True):
            ok = uids != a["uid"]
            if a["least"] is not None:
                ok &= score >= a["least"]
            at = np.flatnonzero(ok)
            if len(at) > k:
                at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
            at = at[np.lexsort((ids[at], nulls[at], -score[at]))[:k]]
            yield from ((a["uid"], None if nulls[i] else int(ids[i]), int(score[i]), None) for i in at.tolist())

    def multiply(batches):
        for batch in batches:
            out = []
            for asked, wide, d, pivot, uids, ids, nulls, vs in zip(*(batch.column(c).to_pylist() for c in ("asked", "wide", "d", "pivot", "uids", "ids", "nulls", "vs")), strict=True):
                v = unpacked(vs, d, pivot < 0, scale)
                q = unpacked(b"".join(a["q"] for a in asked), d, wide, scale)
                out += (exact if wide or pivot < 0 else quick)(asked, q, v, np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["uid", "vec_id", "score", "key"])

    held = blocks.select("block", "pivot", "uids", "ids", "nulls", "vs")
    return asks.join(queries.select("pack", "d", "wide", "asked"), "pack").join(held, "block").select("asked", "wide", "d", "pivot", "uids", "ids", "nulls", "vs").mapInArrow(multiply, "uid long, vec_id long, score long, key binary")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
