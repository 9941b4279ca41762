"""Hashed character n-grams of whole texts, for the linear models."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

LETTER, UPPER, SPACE = 1, 2, 4
STEP = np.uint64(0x9FB21C651E98DF25)


@cache
def kinds() -> np.ndarray:
    """Flags of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = LETTER | UPPER * c.isupper()
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    return out


def code_points(column: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two line feeds, so that no n-gram of a text depends on its neighbours, and n + 1 offsets; null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    texts = (pc.utf8_lower(column) if fold else column).to_pylist()
    codes = np.frombuffer("".join(f"\n{x}\n" for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 2 for x in texts], out=bounds[1:])
    return codes, bounds


def grams(codes: np.ndarray, orders: tuple[int, ...], bits: int, letters_only: bool):
    """For each order the starts of its n-grams and their buckets.

    With ``letters_only`` every other character is a word's border: an n-gram may
    begin or end with one but not run across it. Without it, only white space is.
    """
    flags = kinds()[codes]
    inside = (flags & LETTER) > 0 if letters_only else (flags & SPACE) == 0
    value = common.mix(np.where(inside, codes, 0).astype(np.uint64) * common.BASE + np.uint64(7))
    n, held = len(codes), value.copy()
    middle = np.ones(n, bool)  # all characters between the first and the last
    for k in range(1, max(orders) + 1):
        if k > 1:
            if k > 2:
                middle = middle[: n - k + 1] & inside[k - 2 : n - 1]
            held = held[: n - k + 1] * STEP + value[k - 1 :]
        if k in orders:
            if k == 1:
                at = np.flatnonzero(inside)
            elif k == 2:
                at = np.flatnonzero(inside[:-1] | inside[1:])
            else:
                at = np.flatnonzero(middle[: n - k + 1])
            yield at, (common.mix(held[at] + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)


def doc_sums(codes: np.ndarray, bounds: np.ndarray, weights: np.ndarray, orders: tuple[int, ...], bits: int, letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``weights`` over the n-grams of each text, and their number."""
    n, k = len(bounds) - 1, weights.shape[1]
    sums, counts = np.zeros((n, k)), np.zeros(n, np.int64)
    for at, bucket in grams(codes, orders, bits, letters_only):
        cut = np.searchsorted(at, bounds)
        counts += np.diff(cut)
        for j in range(k):
            total = np.zeros(len(at) + 1)
            np.cumsum(weights[bucket, j], out=total[1:])
            sums[:, j] += total[cut[1:]] - total[cut[:-1]]
    return sums, counts


def doc_counts(codes: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...], bits: int, letters_only: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the buckets of its n-grams and how often each comes."""
    found = list(grams(codes, orders, bits, letters_only))
    cuts = [np.searchsorted(at, bounds) for at, _ in found]
    out = []
    for i in range(len(bounds) - 1):
        buckets = np.concatenate([b[c[i] : c[i + 1]] for (_, b), c in zip(found, cuts, strict=True)]) if found else np.zeros(0, np.int64)
        out.append(np.unique(buckets, return_counts=True))
    return out


def dense(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Relative counts as a matrix; a text without n-grams is a row of zeros."""
    out = np.zeros((len(rows), width), np.float32)
    for i, (buckets, counts) in enumerate(rows):
        if len(buckets):
            out[i, buckets] = counts / counts.sum()
    return out
