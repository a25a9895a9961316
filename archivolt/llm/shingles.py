"""Word shingles of whole texts as 64-bit hashes, by Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from archivolt.llm.shared import mixed, words_of

STEP = np.uint64(0x9E3779B97F4A7C15)  # an odd constant: 2**64 over the golden ratio


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at ASCII white space) behind one another, and offsets by text."""
    words, index, offsets = words_of(pc.ascii_lower(texts))
    coded = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return (coded[index] if len(words) else np.zeros(0, np.uint64)), offsets


MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def folded(word: str) -> str:
    """A word in lower case without the ASCII marks around it, or the word itself where nothing else is left."""
    return word.strip(MARKS).lower() or word


def folded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all folded words, their lengths in characters, and offsets by text."""
    words, index, offsets = words_of(texts)
    words = [folded(w) for w in words]
    coded = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    return (coded[index], size[index], offsets) if len(words) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), offsets)


def chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each position; the last size - 1 positions are left out."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * STEP + hashes[i : i + n]
    return mixed(out ^ np.uint64(size))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their offsets.  A text with fewer than `size` words has its
    whole sequence as one shingle; one without words has none."""
    words, offsets = word_hashes(texts)
    n_words = np.diff(offsets)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    every = chained(words, size)
    at = np.arange(int(begin[-1])) + np.repeat(offsets[:-1] - begin[:-1], n)
    long_enough = np.repeat(n_words >= size, n)
    out = np.empty(len(at), np.uint64)
    out[long_enough] = every[at[long_enough]]
    for i in np.flatnonzero((n_words > 0) & (n_words < size)):
        out[begin[i]] = chained(words[offsets[i] : offsets[i + 1]], int(n_words[i]))[0]
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begin[:-1][n > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[begin]
