"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays."""

from __future__ import annotations

import numpy as np

# Fewer places than this for each letter of an alphabet, and buckets are walked one
# place at a time, else a bucket at a time.
_DENSE = 64


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """The starts of all suffixes in order. ``text`` holds numbers below ``letters``.

    Suffixes are classified as smaller (S) or larger (L) than the one behind them. The
    substrings that begin at the leftmost S places are sorted by inducing and named; the names
    are a shorter text, which is sorted recursively if names repeat. All suffixes
    are then induced from the sorted leftmost ones, in time linear in the text.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = _smaller(text)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[1:] = smaller[1:] & ~smaller[:-1]
    leftmost = np.flatnonzero(is_leftmost)
    induce = _by_bucket if n >= _DENSE * letters else _by_place
    found = induce(text, smaller, leftmost, letters)
    if len(leftmost) > 1:
        found = found[is_leftmost[found]]
        names, n_names = _names(text, leftmost, found)
        if n_names < len(leftmost):
            order = suffix_array(names, n_names)
        else:
            order = np.empty(len(names), np.int64)
            order[names] = np.arange(len(names))
        found = induce(text, smaller, leftmost[order], letters)
    return found


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the last one is larger."""
    n = len(text)
    place = np.full(n, n - 1)
    place[:-1] = np.where(text[1:] != text[:-1], np.arange(n - 1), n - 1)
    place = np.minimum.accumulate(place[::-1])[::-1]
    behind = np.minimum(place + 1, n - 1)
    return text[behind] > text[place]


def _names(text: np.ndarray, leftmost: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each leftmost substring, in text order; equal ones share it."""
    n = len(text)
    length = np.full(n, n)
    length[leftmost[:-1]] = np.diff(leftmost)
    a, b = found[:-1], found[1:]
    same = (length[a] == length[b]) & (length[a] < n)
    open_ = np.flatnonzero(same)
    done = 0
    while len(open_):
        at = np.minimum(done + np.arange(16), length[a[open_], None])
        equal = (text[a[open_, None] + at] == text[b[open_, None] + at]).all(axis=1)
        same[open_[~equal]] = False
        done += 16
        open_ = open_[equal]
        open_ = open_[length[a[open_]] >= done]
    numbers = np.concatenate([[0], np.cumsum(~same)])
    name_at = np.empty(n, np.int64)
    name_at[found] = numbers
    return name_at[leftmost], int(numbers[-1]) + 1


def _bounds(text: np.ndarray, smaller: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each letter's L places, and its S places, begin; both have one end more."""
    of_l = np.bincount(text[~smaller], minlength=letters)
    of_s = np.bincount(text[smaller], minlength=letters)
    ends = np.cumsum(of_l + of_s)
    first_l = np.concatenate([[0], ends])
    return first_l, np.append(first_l[:-1] + of_l, ends[-1])


def _by_bucket(
    text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, letters: int
) -> np.ndarray:
    """All suffixes, induced from seeds; a bucket's places are looked at together."""
    n = len(text)
    first_l, first_s = _bounds(text, smaller, letters)
    small = text.astype(np.uint16) if letters <= 1 << 16 else text
    found = np.empty(n, np.int64)
    free = first_s[:-1].copy()

    def put(items: np.ndarray, step: int) -> None:
        """Put items into the next free places of their letters, upwards or downwards."""
        order = np.argsort(small[items], kind="stable")
        items = items[order]
        group = text[items]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        counts = np.diff(np.append(starts, len(items)))
        rank = np.arange(len(items)) - np.repeat(starts, counts)
        found[free[group] + (rank if step > 0 else -1 - rank)] = items
        free[group[starts]] += step * counts

    def induce(batch: np.ndarray, to_smaller: bool) -> None:
        before = batch[batch > 0] - 1
        before = before[smaller[before] == to_smaller]
        if len(before):
            put(before, -1 if to_smaller else 1)

    if len(seeds):
        put(seeds, 1)
    n_seeds = free - first_s[:-1]
    free = first_l[:-1].copy()
    put(np.array([n - 1]), 1)
    for c in range(letters):
        at = first_l[c]
        while at < free[c]:
            at, done = free[c], at
            induce(found[done:at], False)
        if n_seeds[c]:
            induce(found[first_s[c] : first_s[c] + n_seeds[c]], False)
    free = first_l[1:].copy()
    for c in range(letters - 1, -1, -1):
        at = first_l[c + 1]
        while at > free[c]:
            at, done = free[c], at
            induce(found[at:done][::-1], True)
        if first_s[c] > first_l[c]:
            induce(found[first_l[c] : first_s[c]][::-1], True)
    return found


def _by_place(
    text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, letters: int
) -> np.ndarray:
    """The same, place by place: for large alphabets, whose buckets hold few places."""
    n = len(text)
    first_l, first_s = _bounds(text, smaller, letters)
    # The letter before each place if that is an L place, or an S place; else -1, as for
    # the empty places, which are -1 and so take the last entry.
    before = np.full((2, n + 1), -1)
    before[:, 1:n] = text[:-1]
    before[0, 1:n][smaller[:-1]] = -1
    before[1, 1:n][~smaller[:-1]] = -1
    l_before, s_before = before.tolist()
    found = [-1] * n
    free = first_s.tolist()
    for item, c in zip(seeds.tolist(), text[seeds].tolist(), strict=True):
        found[free[c]] = item
        free[c] += 1
    free = first_l.tolist()
    last = int(text[n - 1])
    found[free[last]] = n - 1
    free[last] += 1
    # Both loops read places that they have filled before.
    for item in found:
        c = l_before[item]
        if c >= 0:
            at = free[c]
            found[at] = item - 1
            free[c] = at + 1
    free = first_l[1:].tolist()
    for item in reversed(found):
        c = s_before[item]
        if c >= 0:
            free[c] = at = free[c] - 1
            found[at] = item - 1
    return np.array(found, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the place before it in suffix order, and how long both are the same.

    ``text`` holds bytes. ``left`` is how many bytes of each place count, 0 for a
    separator; no common prefix is longer. Values are permuted into text order: a place
    whose letter before equals that before its neighbour has the value of the place
    before less one, so only the others are compared, eight bytes at a time.
    """
    n = len(text)
    neighbour = np.full(n, -1)
    neighbour[order[1:]] = order[:-1]
    here = np.arange(1, n)
    there = neighbour[1:]
    follows = np.zeros(n, bool)
    follows[1:] = (there > 0) & (text[here - 1] == text[there - 1]) & (left[here - 1] > 0)
    follows[1:] &= left[np.maximum(there - 1, 0)] > 0
    heads = np.flatnonzero(~follows)
    a = heads[neighbour[heads] >= 0]
    b = neighbour[a]
    most = np.minimum(left[a], left[b])
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eights = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    same = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        at = same[open_]
        differ = eights[a[open_] + at] ^ eights[b[open_] + at]
        lowest = (differ & (~differ + np.uint64(1))).astype(np.float64)
        apart = differ != 0
        grown = np.full(len(open_), 8)
        grown[apart] = np.log2(lowest[apart]).astype(np.int64) // 8
        same[open_] += grown
        open_ = open_[~apart & (same[open_] < most[open_])]
    prefix = np.zeros(n, np.int64)
    prefix[a] = np.minimum(same, most)
    head = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return neighbour, np.where(follows, prefix[head] - (np.arange(n) - head), prefix)
