"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other; each model sees which words, beginnings
of words and shapes of words a text has, and the probabilities of the categories before it.  For training, those probabilities come from models that have not seen the row (out of fold),
so that later models learn from guesses as good as those they get in use."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.shared import dropped, slices, table, texts_of, words_of, written
from archivolt.llm.shingles import folded

SAMPLE = 12_000  # labelled rows that a chain is fitted on, at most
FOLDS = 4
BEGINNINGS = (3, 4, 5, 6)
LEAST, DEVIATIONS = 4, 6.0  # rows that have a feature, and how far its share must differ between the classes
AGAIN = 1  # the feature of a word that follows itself


class Kinds(dict):
    """For str.translate: upper-case letters, other letters and digits as A, a and 9; all else as it is."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return kind


KINDS, RUN = Kinds(), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """The kinds of a word's characters, each run as one."""
    if word.isalpha():
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
    return RUN.sub(r"\1", word.translate(KINDS))


def features_of(words: list[str]) -> np.ndarray:
    """64-bit features of each word: itself folded, its beginnings and its shape."""
    digest, rows = xxhash.xxh3_64_intdigest, []
    for w in words:
        f = folded(w)
        rows.append((digest(f), *(digest(f"{f[:n]}-") for n in BEGINNINGS), digest(f"={shape(w)}")))
    return np.array(rows, np.uint64).reshape(len(words), len(BEGINNINGS) + 2).view(np.int64)


def distinct_features(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) without repeats, over whole texts; with a sorted array `known`, of those features only, and
    their place in it instead of themselves."""
    words, index, offsets = words_of(texts)
    features = features_of(words)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    again = np.zeros(len(index), bool)
    again[1:] = index[1:] == index[:-1]
    again[offsets[:-1][np.diff(offsets) > 0]] = False
    if known is None:
        every, code = np.unique(np.append(features.ravel(), AGAIN), return_inverse=True)
        width = len(every)
        word = np.unique(text * len(words) + index)  # each word of a text once
        coded = (word // len(words) * width)[:, None] + code[:-1].reshape(features.shape)[word % len(words)] if len(words) else np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate([coded.ravel(), text[again] * width + code[-1]]))
        return pairs // width, every[pairs % width]
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, features), len(known) - 1)
    place[known[place] != features] = -1
    some = (place >= 0).any(axis=1)[index]
    found, of = place[index[some]], text[some]
    pairs = (of[:, None] * len(known) + found)[found >= 0]
    at = int(np.searchsorted(known, AGAIN))
    if at < len(known) and known[at] == AGAIN:
        pairs = np.concatenate([pairs, text[again] * len(known) + at])
    pairs = np.unique(pairs)
    return pairs // len(known), pairs % len(known)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(row: np.ndarray, feature: np.ndarray, dense: np.ndarray, label: np.ndarray, weight: np.ndarray, width: int, ridge: float = 1e-4, steps: int = 300, close: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on rows of positive weight: weights of the features and of the dense columns.

    The least mean loss plus ridge / 2 times the squares of the features' weights, by L-BFGS, until no part of the
    gradient exceeds `close`.  Features that the same rows have get the same weight, so one stands for all of them (told
    by the sum of 64 random bits a row), scaled by the root of their number; those that no row has keep 0."""
    live = weight[row] > 0
    row, feature = row[live], feature[live]
    by = np.argsort(feature, kind="stable")
    used, first = np.unique(feature[by], return_index=True)
    marks = np.random.default_rng(5).integers(0, 1 << 64, len(label), np.uint64)
    alike = np.add.reduceat(marks[row[by]], first) if len(used) else np.zeros(0, np.uint64)
    _, lead, group, times = np.unique(alike, return_index=True, return_inverse=True, return_counts=True)
    column = np.full(width, -1)
    column[used[lead]] = np.arange(len(lead))
    own = column[feature]
    row, own = row[own >= 0], own[own >= 0]
    root, n = np.sqrt(times), len(lead)
    by_row, by_column = np.argsort(row, kind="stable"), np.argsort(own, kind="stable")
    of_row, row_first = own[by_row], np.unique(row[by_row], return_index=True)
    of_column, column_first = row[by_column], np.searchsorted(own[by_column], np.arange(n))
    share = weight / max(1e-9, weight.sum())
    damp = np.append(np.full(n, ridge), np.zeros(dense.shape[1]))

    def odds(x: np.ndarray) -> np.ndarray:
        out = (dense * x[n:]).sum(axis=1)
        if n:
            out[row_first[0]] += np.add.reduceat((root * x[:n])[of_row], row_first[1])
        return out

    def loss(z: np.ndarray, x: np.ndarray) -> float:
        return float((share * (np.logaddexp(0, z) - label * z)).sum() + (damp * x * x).sum() / 2)

    def gradient(z: np.ndarray, x: np.ndarray) -> np.ndarray:
        error = (sigmoid(z) - label) * share
        of = root * np.add.reduceat(error[of_column], column_first) if n else np.zeros(0)
        return np.append(of, (dense * error[:, None]).sum(axis=0)) + damp * x

    x, z = np.zeros(n + dense.shape[1]), np.zeros(len(label))
    g, past = gradient(z, x), []
    for _ in range(steps):
        if np.abs(g).max() <= close:
            break
        d, sums = -g, []
        for s, y in reversed(past):
            sums.append((s @ d) / (s @ y))
            d = d - sums[-1] * y
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for s, y in past:
            d = d + (sums.pop() - (y @ d) / (s @ y)) * s
        dz, now, slope, a = odds(d), loss(z, x), g @ d, 1.0
        while loss(z + a * dz, x + a * d) > now + 1e-4 * a * slope and a > 1e-10:
            a /= 2
        x, z = x + a * d, z + a * dz
        was, g = g, gradient(z, x)
        if (g - was) @ d > 0:
            past = [*past[-9:], (a * d, g - was)]
    full = np.zeros(width)
    full[used] = (x[:n] / root)[group]
    return full, x[n:]


def telling(counts: DataFrame, totals: dict[tuple, float], n: int) -> DataFrame:
    """All features that tell the classes of a model apart: with `use`, the models that may see each.  counts: feature,
    fold, y0.. and k, the rows; a model is (category, the fold left out, or FOLDS for none)."""
    sums, tests = [], []
    for c in range(n):
        for f in range(FOLDS + 1):
            for y in (0, 1):
                sums.append(F.sum(F.when((F.col(f"y{c}") == y) & (F.col("fold") != f), F.col("k")).otherwise(0)).alias(f"n{c}_{f}_{y}"))
            one, zero = (F.col(f"n{c}_{f}_{y}") for y in (1, 0))
            n_one, n_zero = (float(max(1.0, sum(v for (cc, fold, yy), v in totals.items() if (cc, yy) == (c, y) and fold != f))) for y in (1, 0))
            share = (one + zero + 1) / (n_one + n_zero + 2)
            z = F.abs(one / n_one - zero / n_zero) / F.sqrt(share * (1 - share) * (1 / n_one + 1 / n_zero))
            tests.append(F.when((one + zero >= LEAST) & (z >= DEVIATIONS), F.lit(c * (FOLDS + 1) + f)))
    return counts.groupBy("feature").agg(*sums).select("feature", F.array_compact(F.array(*tests)).alias("use")).filter("size(use) > 0")


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Features and one model a category: their weights, and those of (1, log-odds of the categories before).

    Fitted on at most SAMPLE labelled ids, the least by a hash of doc_id, each with the least of its labels and one of
    its texts.  categories: name -> column of 0/1 over
    `labels`, in the order of the chain; null for unknown.  Features are counted by class in Spark; those that tell
    the classes apart come to the driver, and the sample's rows by those features alone."""
    n = len(categories)
    ys = [f"y{i}" for i in range(n)]
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.min(c.cast("int")), F.lit(-1)).alias(y) for y, c in zip(ys, categories.values(), strict=True)])
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumn("fold", F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3), F.lit(FOLDS)).cast("int"))
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "fold", *ys).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    texts = written(texts.select("doc_id", "t.text", "fold", *ys), "labelled")
    kinds = "fold int, " + ", ".join(f"{y} int" for y in ys)

    def count(batches):
        for batch in slices(batches, 3 << 20):
            text, feature = distinct_features(texts_of(batch.column("text")))
            cell = np.zeros(batch.num_rows, np.int64)
            for c in ("fold", *ys):
                cell = cell * 8 + batch.column(c).to_numpy(zero_copy_only=False) + 1
            pairs = np.stack([feature, cell[text]], axis=1)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])) if len(pairs) else np.zeros(0, np.int64)
            k, cells, cols = np.diff(np.append(first, len(pairs))), pairs[first, 1], []
            for _ in range(n + 1):
                cols.append(pa.array((cells % 8 - 1).astype(np.int32)))
                cells = cells // 8
            yield pa.RecordBatch.from_arrays([pa.array(pairs[first, 0]), *cols[::-1], pa.array(k)], names=["feature", "fold", *ys, "k"])

    totals: dict[tuple, float] = {}
    for r in texts.groupBy("fold", *ys).count().collect():
        for c, y in enumerate(ys):
            key = (c, r["fold"], r[y])
            totals[key] = totals.get(key, 0) + r["count"]
    counts = texts.mapInArrow(count, f"feature long, {kinds}, k long").groupBy("feature", "fold", *ys).agg(F.sum("k").alias("k"))
    found = sorted((r["feature"], r["use"]) for r in telling(counts, totals, n).collect())
    known = np.array([f for f, _ in found], np.int64)
    allowed = np.zeros((n * (FOLDS + 1), len(found)), bool)
    for i, (_, use) in enumerate(found):
        allowed[use, i] = True

    def lists(batches):
        for batch in slices(batches, 3 << 20):
            text, at = distinct_features(texts_of(batch.column("text")), known)
            edges, raw = (4 * np.searchsorted(text, np.arange(batch.num_rows + 1))).tolist(), at.astype(np.int32).tobytes()
            held = pa.array([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "fold", *ys)), held], names=["doc_id", "fold", *ys, "at"])

    rows = texts.mapInArrow(lists, f"doc_id long, {kinds}, at binary").collect()
    dropped(texts)
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["at"])))
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) // 4 for r in rows]).astype(np.int64)
    at = np.frombuffer(b"".join(r["at"] for r in rows), np.int32).astype(np.int64)
    fold = np.array([r["fold"] for r in rows], np.int64)
    dense, models = np.ones((len(rows), 1)), []

    def model(c: int, f: int):
        use = allowed[c * (FOLDS + 1) + f]
        mine = use[at] if len(at) else np.zeros(0, bool)
        y = np.array([r[ys[c]] for r in rows], np.int64)
        w, v = fitted(row[mine], at[mine], dense, np.maximum(y, 0).astype(float), ((y >= 0) & (fold != f)).astype(float), len(found))
        return np.where(use, w, 0.0), v

    for c in range(n):
        apart = np.zeros(len(rows))
        for f in range(FOLDS) if c + 1 < n else ():
            w, v = model(c, f)
            apart = np.where(fold == f, np.bincount(row, w[at], len(rows)) + dense @ v, apart)
        models.append(model(c, FOLDS))
        dense = np.concatenate([dense, np.clip(apart, -8, 8)[:, None]], axis=1)
    return known, models


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Adds p_<category> (0 to 1) to every row of docs(doc_id, text), with the columns named in `keep` beside it.

    Null and empty texts have no words and get the base rates; repeated rows are scored each; null doc_ids are scored
    but never trained on; texts of any length are read whole; no rows give no rows.  Of labels that contradict each
    other the least counts, of different texts with one doc_id the one with the least hash.  Without labelled rows every
    probability is 0.5.  Other columns are ignored, but for those in `keep`, whose names may be any but those added.
    What goes to the tasks is bounded by SAMPLE, whatever the size of the corpus."""
    clash = {f"p_{c}" for c in categories} & set(keep or ())
    if clash:
        raise ValueError(f"columns to keep have the names of those added: {sorted(clash)}")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(fit_chain(docs.select("doc_id", "text"), labels, categories))
    kept, added = list(keep or ["doc_id"]), [f"p_{c}" for c in categories]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def score(batches):
        known, models = shared.value
        for batch in slices(batches, 3 << 20):
            text, at = distinct_features(texts_of(batch.column("text")), known)
            dense, out = np.ones((batch.num_rows, 1)), []
            for w, v in models:
                odds = np.bincount(text, w[at], batch.num_rows) + dense @ v
                dense = np.concatenate([dense, np.clip(odds, -8, 8)[:, None]], axis=1)
                out.append(pa.array(sigmoid(odds)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], names=[*kept, *added])

    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{c} double" for c in added])
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(score, schema)


def categories() -> dict[str, Column]:
    """The chain of the given labels: whether a text is degraded, and then whether it is toxic."""
    return {"degraded": (F.col("quality") == 0).cast("int"), "toxic": F.col("toxic")}


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    found = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, categories())
    return found.select("doc_id", "p_degraded", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))
