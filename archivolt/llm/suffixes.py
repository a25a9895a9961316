"""Suffix arrays of bounded byte buffers in numpy, and common prefixes of neighbours in them."""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of text in order, by Larsson and Sadakane's refinement: ordered by their first eight bytes, and
    then only groups that are still equal are sorted again, by the rank of the suffix that begins where the common
    part ends, which doubles that part each time."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    first = words_at(text)
    order = np.argsort(first, kind="stable")
    sorted_first = first[order]
    starts = np.concatenate([[True], sorted_first[1:] != sorted_first[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    place = order.astype(np.int64)
    h = 8
    while True:
        single = np.concatenate([starts[1:], [True]]) & starts
        active = np.flatnonzero(~single)  # slots of the array that lie in groups of two and more
        if not len(active):
            break
        suffix = place[active]
        group = rank[suffix]
        after = suffix + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)], n - 1 - after)  # past the end: the shorter first
        by = np.lexsort((second, group))
        suffix, group, second = suffix[by], group[by], second[by]
        place[active] = suffix
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        starts[active] = fresh
        rank[suffix] = np.maximum.accumulate(np.where(fresh, active, 0))
        h *= 2
    return place


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each slot of the suffix array the bytes shared with the slot before, up to cap (slot 0: none).

    order must be the whole order of all suffixes.  As Kasai's bound has it, the suffix one byte on shares at least one byte less with its own predecessor.  Text
    positions are taken in waves, every 64th first and then those halfway between, so that a whole wave starts from
    the bounds that positions to its left have left behind."""
    n = len(order)
    if n < 2:
        return np.zeros(n, np.int64)
    words = words_at(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    step = 64
    todo = [np.arange(0, n, step)] + [np.arange(s, n, 2 * s) for s in (32, 16, 8, 4, 2, 1)]
    for wave, gap in zip(todo, (0, 32, 16, 8, 4, 2, 1), strict=True):
        have = np.maximum(shared[wave - gap] - gap, 0) if gap else np.zeros(len(wave), np.int64)
        ok = before[wave] >= 0
        at, other, have = wave[ok], before[wave[ok]], have[ok]
        left = np.arange(len(at))
        while len(left):
            i, j = at[left] + have[left], other[left] + have[left]
            room = (i < n) & (j < n)
            differ = np.where(room, words[np.minimum(i, n - 1)] ^ words[np.minimum(j, n - 1)], np.uint64(1 << 63))
            more = np.zeros(len(left), np.int64)
            for k in range(1, 9):
                more += (differ >> np.uint64(64 - 8 * k)) == 0
            have[left] = np.minimum(have[left] + more, n - np.maximum(at[left], other[left]))
            left = left[(more == 8) & (have[left] < cap)]
        shared[at] = np.minimum(have, cap)
    return shared[order]


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the positions `starts` begin a string of `length` bytes that begins at another of them too.  The string
    must lie within text for each of them."""
    order = suffix_array(text)
    shared = common_prefixes(text, order, length)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    # runs of slots joined by prefixes of full length; only wanted positions count within a run
    run = np.cumsum(shared < length)
    mine = wanted[order]
    count = np.bincount(run[mine], minlength=int(run[-1]) + 1 if len(run) else 0)
    out = np.zeros(len(text), bool)
    out[order[mine]] = count[run[mine]] > 1
    return out[starts]
