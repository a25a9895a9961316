"""Packing by minimum bin slack.

Documents are cut into pieces of at most the window's size.  The lengths of the pieces make a histogram with one
count per length, whatever the size of the corpus.  For one window after the other, the longest piece left begins it
and a subset-sum over a bitset finds the multiset of remaining lengths that comes closest to the capacity; backtracking
gives how often it takes each length.  The multiset is then used for as many windows as the counts allow, so that the number of steps follows the
number of distinct lengths and not that of documents.  Pieces find their window by their rank within their length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.shared import ranked, salts, slices, table, texts_of, written
from archivolt.llm.tokens import Encoder

#: Bytes of text that a task encodes at a time.
SLICE = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset (length, times) of counts whose sum is the largest up to capacity; ties prefer long pieces.

    Bit s of the set is on if the lengths looked at so far can sum to s.  Counts are split in powers of two, and the
    bitset before each step is kept for the way back."""
    steps, seen = [], 1
    full = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, power = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(power, left)
            steps.append((length, take, seen))
            seen |= (seen << (length * take)) & full
            left -= take
            power *= 2
        if seen >> capacity & 1:
            break
    total, took = seen.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            took[length] = took.get(length, 0) + take
    return sorted(took.items(), reverse=True)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset for the next window: the longest piece left, which has the fewest places it fits, and the best fill of
    what remains beside it."""
    longest = max(counts)
    rest = {length: n - (length == longest) for length, n in counts.items() if length <= capacity - longest}
    took = dict(best_fill({length: n for length, n in rest.items() if n}, capacity - longest))
    took[longest] = took.get(longest, 0) + 1
    return sorted(took.items(), reverse=True)


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, per_window, first_window, offset): pieces of this length with ranks from first_rank
    go into windows from first_window, per_window of them in each, the first at offset."""
    left = {k: v for k, v in histogram.items() if v > 0}
    used, rows, window = dict.fromkeys(left, 0), [], 0
    while left:
        fill = fullest(left, capacity)
        times = min(left[length] // n for length, n in fill)
        offset = 0
        for length, n in fill:
            rows.append((length, used[length], n, window, offset))
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
            offset += length * n
        window += times
    return rows


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    def cut(batches):
        encoder = Encoder.at(tokenizer_path)
        for batch in slices(batches, SLICE):
            ids, begin = encoder.encode(texts_of(batch.column("text")))
            names = batch.column("doc_id").to_pylist()
            raw, rows = memoryview(ids.astype("<u4").tobytes()), []
            for name, a, b in zip(names, begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                for start in range(a, b, capacity):
                    stop = min(b, start + capacity)
                    rows.append((name, start - a, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), b - a))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Packs every document of docs(doc_id, text) into windows of at most capacity tokens.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null text
    counts as empty and is the end id alone; a text of any length is cut into as many pieces as it needs; a null doc_id
    is kept; repeated rows are packed each; other columns are ignored; no rows give no rows.  Pieces of equal length
    differ by rank alone, so ties change nothing.  Only the histogram of lengths (capacity numbers) reaches the driver.
    The plan sent back grows with the logarithm of its counts: a step uses a multiset as often as they allow."""
    pieces = written(pieces_of(docs, tokenizer_path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_windows(histogram, capacity)
    steps: dict[int, list] = {length: [] for length in histogram}
    for length, *step in plan:
        steps[length].append(step)
    by_length = {length: np.array(rows, np.int64) for length, rows in steps.items()}
    total = sum(histogram.values())
    at = ranked(pieces, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], salts(total), "rank")

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            window, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for value, rows in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                steps = by_length[value]
                step = steps[np.searchsorted(steps[:, 0], rank[rows], side="right") - 1]
                within = rank[rows] - step[:, 0]
                window[rows] = step[:, 2] + within // step[:, 1]
                offset[rows] = step[:, 3] + within % step[:, 1] * value
            cols = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(window), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return at.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
