"""Suffix arrays by induced sorting, with numpy doing a bucket's suffixes at a time."""

from __future__ import annotations

import numpy as np

from . import common

#: Characters beyond this are written as digits where that makes a shorter text than the one that names them, as a step for each bucket would cost more.
LARGE = 2000
#: Texts up to this length end the recursion.
SHORT = 1 << 17


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last character is a unique smallest one."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.where(at < n - 1, np.append(step, 1)[at] > 0, False)
    return out


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from an order of the leftmost-smaller ones."""
    n = len(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(n, -1, np.int64)
    text = text.astype(np.uint16) if len(sizes) <= 1 << 16 else text  # sorted by radix
    count = np.arange(n)

    def deal(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stable order by character; each run's character and size, and each one's place in its run."""
        k = len(chars)
        order = chars.argsort(kind="stable")
        chars = chars[order]
        new = np.empty(k, bool)
        new[0] = True
        np.not_equal(chars[1:], chars[:-1], out=new[1:])
        head = new.nonzero()[0]
        size = np.empty(len(head), np.int64)
        np.subtract(head[1:], head[:-1], out=size[:-1])
        size[-1] = k - head[-1]
        return order, chars[head], size, count[:k] - head.repeat(size)

    seeds = np.zeros(len(sizes), np.int64)
    if len(lms):
        order, runs, size, within = deal(text[lms])
        seeds[runs] = size
        out[np.repeat(ends[runs] - size, size) + within] = lms[order]

    heads = starts.copy()

    def larger(chunk: np.ndarray) -> None:
        p = chunk[chunk > 0] - 1
        p = p[~small[p]]
        if len(p):
            order, runs, size, within = deal(text[p])
            out[heads[runs].repeat(size) + within] = p[order]
            heads[runs] += size

    for c in np.flatnonzero(sizes).tolist():
        i = starts[c]
        while i < heads[c]:
            i, j = heads[c], i
            larger(out[j:i])
        if seeds[c]:
            larger(out[ends[c] - seeds[c] : ends[c]].copy())

    tails = ends.copy()
    tails[0] -= 1  # the last character stands where it is

    def smaller(chunk: np.ndarray) -> None:
        p = chunk[chunk > 0] - 1
        p = p[small[p]]
        if len(p):
            order, runs, size, within = deal(text[p])
            out[tails[runs].repeat(size) - 1 - within] = p[order]
            tails[runs] -= size

    for c in np.flatnonzero(sizes)[::-1].tolist():
        i = ends[c] - (c == 0)
        while i > tails[c]:
            i, j = tails[c], i
            smaller(out[i:j][::-1].copy())
        smaller(out[starts[c] : heads[c]][::-1].copy())
    return out


def digits_of(most: int) -> tuple[int, int]:
    """How many digits write the characters from 1 to ``most``, and their base: no more digits than needed, all of one size."""
    width = 2
    while LARGE**width < most:
        width += 1
    base = max(2, round(most ** (1 / width)))
    return width, base + (base**width < most)


def by_digits(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text with a large alphabet, from that of its characters' digits.

    All characters but the last have as many digits, so suffixes that begin at a
    character are in the order of the characters.
    """
    width, base = digits_of(int(text.max()))
    rest, digits = text[:-1] - 1, np.empty((len(text) - 1, width), np.int64)
    for i in range(width)[::-1]:
        rest, digits[:, i] = np.divmod(rest, base)
    order = suffix_array(np.append(digits.ravel() + 1, 0))
    return order[order % width == 0] // width


def by_ranks(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by rank doubling; only suffixes that are not yet alone are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)

    def heads(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return at[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]

    rank[order] = heads(text[order], np.arange(n))
    step, open_at = 1, np.arange(n)
    while True:
        ranks = rank[order[open_at]]
        same = ranks[1:] == ranks[:-1]
        alone = np.ones(len(open_at), bool)
        alone[1:] &= ~same
        alone[:-1] &= ~same
        open_at = open_at[~alone]
        if not len(open_at):
            return order
        place = order[open_at]
        keys = rank[place] * (n + 1) + np.where(place + step < n, rank[np.minimum(place + step, n - 1)] + 1, 0)
        inner = np.argsort(keys, kind="stable")
        order[open_at] = place[inner]
        rank[place[inner]] = heads(keys[inner], open_at)
        step *= 2


def suffix_array(text: np.ndarray, most: float = np.inf) -> np.ndarray:
    """Of characters from 0 on; the last one, 0, comes nowhere else.

    Suffixes are classified; the leftmost-smaller substrings are sorted by inducing,
    named, and the string of their names is sorted recursively; the whole order is
    then induced from theirs. Substrings are told apart by length and a 64-bit hash.
    A large alphabet is written in digits if that takes fewer than ``most``; short
    texts of names end the recursion and are sorted by their ranks.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    if n <= SHORT and most < np.inf:
        return by_ranks(text)
    if text.max() > LARGE and digits_of(int(text.max()))[0] * n < most:
        return by_digits(text)
    small = types(text)
    sizes = np.bincount(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = induce(text, small, lms, sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    ends = np.append(lms[1:], n - 1) + 1
    hashes = common.Rolling(common.mix(text.astype(np.uint64) * common.BASE + np.uint64(5))).segment(lms, ends)
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    k = number[ordered]
    new = np.ones(len(k), bool)
    new[1:] = (hashes[k[1:]] != hashes[k[:-1]]) | ((ends - lms)[k[1:]] != (ends - lms)[k[:-1]])
    names = np.empty(len(lms), np.int64)
    names[k] = np.cumsum(new) - 1
    return induce(text, small, ordered if new.all() else lms[suffix_array(names, 0.9 * n)], sizes)


def common_prefixes(text: np.ndarray, order: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """The permuted common prefixes: in text order, each suffix's with the one before it in the array, ``most`` at most.

    ``left`` has the characters from each place to the end of its string, beyond which
    no prefix goes. Where the characters before two neighbours are equal, their common
    prefix is one less than that of the place before; the other, irreducible ones are
    found by hashes, in steps that double while they agree and are halved after that.
    """
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    free = np.ones(n, bool)
    at = np.flatnonzero(before[1:] > 0) + 1
    free[at] = text[at - 1] != text[before[at] - 1]
    i = np.flatnonzero(free & (before >= 0))
    j, hashes = before[i], common.Rolling(common.mix(text.astype(np.uint64) * common.BASE + np.uint64(7)))
    limit, found = n - np.maximum(i, j), np.zeros(len(i), np.int64)

    def grow(some: np.ndarray, step: int) -> np.ndarray:
        """Of some places, those whose prefix is longer by a step, made so."""
        some = some[found[some] + step <= limit[some]]
        a, b = i[some] + found[some], j[some] + found[some]
        some = some[hashes.segment(a, a + step) == hashes.segment(b, b + step)]
        found[some] += step
        return some

    some, step, tried = np.arange(len(i)), 1, []
    while len(some):
        tried.append(some)
        some, step = grow(some, step), 2 * step
    for k in range(len(tried) - 2, -1, -1):  # whoever took a step failed at a larger one
        grow(tried[k + 1], 1 << k)
    out = np.zeros(n, np.int64)
    out[i] = found
    head = np.maximum.accumulate(np.where(free, np.arange(n), 0))
    out = np.maximum(out[head] - (np.arange(n) - head), 0)
    return np.minimum(np.minimum(out, most), np.minimum(left, left[np.maximum(before, 0)]))
