"""Passages of benchmark items in documents.

A window of a document is as many words as an item has; a document with fewer words is one window.  Each window and each
item gets a 64-bit SimHash of its word shingles, weighted by their letters.  The fingerprint's blocks are searched each
within its share of the radius, which finds every item within the radius: were each block further away than its share,
the whole would be too.  Candidates are verified by the exact weighted similarity of their shingle multisets.  Only
windows that hold a shingle of the benchmark are looked at, which loses nothing: without a common shingle the similarity
is 0.  At a similarity of 0.8 the fingerprints differ in 9.7 bits on average with a deviation of 2.9, so that the radius
of 20 leaves out one in 10**4; of unrelated pairs 3.5 % pass a block, by its distances alone, and 0.1 % both."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.shared import slices, table, texts_of, written
from archivolt.llm.shingles import chained, folded_words

RADIUS, BLOCKS = 20, 2
PAIRS = 1 << 21  # of windows and items that are compared at a time
ITEM_WORDS = 1_000_000  # words of items in one index; more items make more passes
SLICE = 1 << 20  # bytes of texts that are looked at together; what they need is some forty times that
STRETCH = 8192  # words of a document whose bit sums are held at once


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """Each hash as 64 numbers of 1 or -1."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


class Items:
    """Items of equal word count: fingerprints, the block index, and shingle weights for the verification."""

    def __init__(self, size: int, words: int):
        self.size, self.words = size, words  # of a shingle and of a window
        self.ids: list[int] = []
        self.bags: list[dict[int, int]] = []
        self.prints: list[int] = []

    def add(self, item: int, hashes: np.ndarray, weights: np.ndarray) -> None:
        bag: dict[int, int] = {}
        for h, w in zip(hashes.tolist(), weights.tolist(), strict=True):
            bag[h] = bag.get(h, 0) + w
        self.ids.append(item)
        self.bags.append(bag)
        self.prints.append(int(fingerprint((bits_of(hashes) * weights[:, None]).sum(axis=0)[None])[0]))

    def index(self) -> None:
        """The items' blocks, each with its share of the radius.

        Shares are least such that they add up, with one more for all blocks but one, to over the radius: if every
        block differed in more bits than its share, the fingerprints would differ in more than RADIUS."""
        self.table = np.array(self.prints, np.uint64)
        edges = np.linspace(0, 64, BLOCKS + 1).round().astype(int).tolist()
        self.blocks = []
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            cut = (np.uint64(a), np.uint64((1 << (b - a)) - 1))
            self.blocks.append((cut, (RADIUS - BLOCKS + 1 + k) // BLOCKS, block_of(self.table, cut)))

    def passed(self, prints: np.ndarray) -> np.ndarray:
        """Which items have a block within its share of a window's, by window."""
        found = np.zeros((len(prints), len(self.table)), bool)
        for cut, share, own in self.blocks:
            found |= np.bitwise_count(block_of(prints, cut)[:, None] ^ own) <= share
        return found

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within the radius.  Memory has a bound whatever the numbers of windows and items."""
        step, windows, items = max(1, PAIRS // max(1, len(self.table))), [], []
        for a in range(0, len(prints), step):
            for b in range(0, len(self.table), PAIRS):
                part = self if len(self.table) <= PAIRS else self.part(b, b + PAIRS)
                window, item = np.nonzero(part.passed(prints[a : a + step]))
                keep = np.bitwise_count(prints[window + a] ^ self.table[item + b]) <= RADIUS
                windows.append(window[keep] + a)
                items.append(item[keep] + b)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *windows]), np.concatenate([none, *items])

    def part(self, a: int, b: int) -> Items:
        some = Items(self.size, self.words)
        some.table, some.blocks = self.table[a:b], [(cut, share, own[a:b]) for cut, share, own in self.blocks]
        return some


def block_of(prints: np.ndarray, cut: tuple) -> np.ndarray:
    return ((prints >> cut[0]) & cut[1]).astype(np.uint32)


def similarity(one: dict[int, int], hashes: list[int], weights: list[int]) -> float:
    """The least weights over the greatest, shingle by shingle."""
    two: dict[int, int] = {}
    for h, w in zip(hashes, weights, strict=True):
        two[h] = two.get(h, 0) + w
    shared = sum(min(w, one[h]) for h, w in two.items() if h in one)
    total = sum(one.values()) + sum(two.values()) - shared
    return shared / total if total else 0.0


def grouped(rows, size: int) -> list[Items]:
    kinds: dict[int, Items] = {}
    if rows:
        hashes, letters, offsets = folded_words(pa.array([r["text"] for r in rows], pa.large_string()))
        for row, a, b in zip(rows, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b > a:
                k = min(size, b - a)
                kinds.setdefault(b - a, Items(k, b - a)).add(row["item_id"], chained(hashes[a:b], k), summed(letters[a:b], k))
    for x in kinds.values():
        x.index()
    return [kinds[k] for k in sorted(kinds)]


def summed(letters: np.ndarray, k: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(letters)])
    return total[k:] - total[:-k]


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words: for each document and item the window of the document most
    similar to the item, the first of equal ones, where its similarity is at least `least`.

    docs(doc_id, text) and benchmark(item_id, text) may hold nulls (no words, so no match; null ids are kept),
    repeated rows (one result row each) and other columns, which are ignored.  Texts of any length are read whole, with
    memory in proportion to them.  A document with fewer words than an item is compared with
    it whole.  Words are compared in lower case without the marks around
    them.  Items of fewer than `size` words are compared as whole sequences.  Empty tables give no rows.  Items reach the tasks in
    indexes of at most ITEM_WORDS words, or one item; a larger benchmark takes more passes over the documents, each written
    before the next is made, so that neither the driver nor a task holds more than one index."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    passes = int(words // ITEM_WORDS) + 1
    found = None
    for k in range(passes):
        part = grouped(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect(), size)
        one = docs.mapInArrow(finder(part, size, least), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        one = one if passes == 1 else written(one, "leaks")
        found = one if found is None else found.union(one)
    return found


def finder(kinds: list[Items], size: int, least: float):
    by_shingle: dict[int, list[tuple[np.ndarray, list[np.ndarray]]]] = {}
    for k in {x.size for x in kinds}:
        pairs = np.unique(np.array([(h, j) for j, x in enumerate(kinds) if x.size == k for bag in x.bags for h in bag], np.uint64), axis=0)
        by_shingle[k] = (pairs[:, 0], pairs[:, 1].astype(np.int64))

    def find(batches):
        quick = {}
        for k, (known, _) in by_shingle.items():
            quick[k] = np.zeros(1 << 20, bool)
            quick[k][known >> np.uint64(44)] = True
        for batch in slices(batches, SLICE):
            names = batch.column("doc_id").to_pylist()
            hashes, letters, offsets = folded_words(texts_of(batch.column("text")))
            rows = []
            for k, (known, kind) in by_shingle.items():
                every = chained(hashes, k)
                maybe = np.flatnonzero(quick[k][every >> np.uint64(44)])
                at = np.searchsorted(known, every[maybe])
                maybe = maybe[known[np.minimum(at, len(known) - 1)] == every[maybe]]
                text = np.searchsorted(offsets, maybe, side="right") - 1
                ok = maybe + k <= offsets[text + 1]
                maybe, text = maybe[ok], text[ok]
                low, high = np.searchsorted(known, every[maybe]), np.searchsorted(known, every[maybe], side="right")
                weights = summed(letters, k) if len(maybe) else None
                n = high - low
                seed, seed_text = np.repeat(maybe, n), np.repeat(text, n)
                seed_kind = kind[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                for j in np.unique(seed_kind).tolist():
                    x, mine = kinds[j], seed_kind == j
                    start = starts_of(x, seed[mine], seed_text[mine], offsets)
                    rows += verified(x, start, np.searchsorted(offsets, start, side="right") - 1, every, weights, offsets, names, least)
            best: dict[tuple, tuple] = {}
            for i, item, sim, first, n in rows:
                if (i, item) not in best or (-sim, first) < (-best[i, item][0], best[i, item][1]):
                    best[i, item] = (sim, first, n)
            out = [(names[i], x.ids[j], *v) for (i, (x, j)), v in best.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kind_of = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kind_of, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return find


def starts_of(x: Items, seed: np.ndarray, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where windows of x.words words begin that hold one of the places `seed` (in order, each in its text), or the
    whole of a shorter text.  Overlapping stretches of such windows are merged before they are written out."""
    low = np.maximum(offsets[text], seed - (x.words - x.size))
    high = np.minimum(seed, offsets[text + 1] - x.words)
    low, high = np.where(high < offsets[text], offsets[text], low), np.maximum(high, offsets[text])
    some = high >= low
    low, high = low[some], high[some]
    if not len(low):
        return low
    reach = np.maximum.accumulate(high)
    fresh = np.concatenate([[True], low[1:] > reach[:-1]])
    first, last = low[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(low) - 1)]
    n = last - first + 1
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def verified(x: Items, start: np.ndarray, of: np.ndarray, every: np.ndarray, weights: np.ndarray, offsets: np.ndarray, names: list, least: float) -> list:
    """Rows (text, (items, item), similarity, first word, words) of the windows that begin at `start`."""
    rows, words = [], np.minimum(x.words, offsets[of + 1] - offsets[of])
    n = words - x.size + 1
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + STRETCH)))
        base, end = int(start[a]), int((start[a:b] + n[a:b]).max())
        sums = np.zeros((end - base + 1, 64), np.int64)
        np.cumsum(bits_of(every[base:end]) * weights[base:end, None], axis=0, out=sums[1:])
        from_, to = start[a:b] - base, start[a:b] - base + n[a:b]
        window, item = x.near(fingerprint(sums[to] - sums[from_]))
        for w, j in zip((window + a).tolist(), item.tolist(), strict=True):
            s, end = int(start[w]), int(start[w] + n[w])
            sim = similarity(x.bags[j], every[s:end].tolist(), weights[s:end].tolist())
            if sim >= least:
                rows.append((int(of[w]), (x, j), sim, s - int(offsets[of[w]]), int(words[w])))
        a = b
    return rows


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
