"""Periodic runs of words: stretches that repeat what stands a few words before.

Words are numbered exactly, apart for each document, and blocks of 2, 4, 8 … words are named
by the pair of names of their halves (Karp, Miller and Rosenberg 1972), as far up as some
name comes twice; a block whose name comes once needs no further name, so of unlike
text little is left after a few levels. How far two places agree, forwards or backwards,
follows from the names by descending levels (``Names.after``, ``Names.before``).

A run of period q and length l has l - q places that agree with the place q words on. So on
a grid of that spacing at least one place agrees, whose extension in both
directions is the run (Main and Lorentz 1984): ``runs`` tests the grids of all periods
up to the longest block that comes twice, many documents at once, and extends what agrees.
Stretches found with several periods have the smallest one. No hashes, no sorted suffixes.

A text that is null, empty or blank has no words and no runs; equal rows get equal results, ids
may be null or repeated, other columns are never read. A text of any length is
searched whole: n words take about n log(n) grid places, of which blocks of bounded size
are held at a time, and log(n) names a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Settings:
    """Fewest words and repetitions of a run; grid places tested at a time."""

    least: int = 12
    times: int = 2
    block: int = 1 << 19


class Names:
    """Names of the blocks of 1, 2, 4 … values of a sequence; equal names are equal blocks, names below 0 come once."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.size = n
        self.levels = [self._named(np.arange(n), values, n)]
        while (step := 1 << (len(self.levels) - 1)) < n:
            last = self.levels[-1]
            at = np.flatnonzero(last[: n - step] >= 0)
            at = at[last[at + step] >= 0]
            name = self._named(at, last[at] * n + last[at + step], n)
            if not (name >= 0).any():
                break
            self.levels.append(name)

    @staticmethod
    def _named(at: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        out = -1 - np.arange(n, dtype=np.int64)
        _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = count[name] > 1
        out[at[twice]] = name[twice]
        return out

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values from i and from j on are equal; i < j."""
        i, j, begin = i.copy(), j.copy(), j
        for k in range(len(self.levels) - 1, -1, -1):
            name, inside = self.levels[k], np.minimum(j, self.size - 1)
            same = (name[i] == name[inside]) & (j + (1 << k) <= self.size)
            i += same << k
            j += same << k
        return j - begin

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values just before i and before j are equal; i < j."""
        i, j, end = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            name, a = self.levels[k], i - (1 << k)
            same = (a >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(j - (1 << k), 0)])
            i -= same << k
            j -= same << k
        return end - i


def grids(n: int, periods: np.ndarray, spacing: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place) of all grids, in blocks; the place and that a period further lie in the sequence. One grid may exceed a block."""
    counts = -(-(n - periods) // spacing)
    at = 0
    while at < len(periods):
        to = at + max(1, int(np.searchsorted(np.cumsum(counts[at:]), block, "right")))
        some = counts[at:to]
        within = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        yield np.repeat(periods[at:to], some), within * np.repeat(spacing[at:to], some)
        at = to


def runs(doc: np.ndarray, word: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """(start, end, period) of all runs, by start and period; word: numbers, doc: ascending numbers of the documents."""
    n = len(word)
    found = np.zeros((0, 3), np.int64)
    if n < s.least:
        return found
    names = Names(doc * (int(word.max()) + 1) + word)
    if (names.levels[0] < 0).all():
        return found
    most = min(int(np.bincount(doc).max()) // s.times, (1 << len(names.levels)) - 1, n - 1)
    periods = np.arange(1, most + 1)
    first = names.levels[0]
    for q, i in grids(n, periods, np.maximum(periods * (s.times - 1), s.least - periods), s.block):
        same = first[i] == first[i + q]
        q, i = q[same], i[same]
        begin, end = i - names.before(i, i + q), i + q + names.after(i, i + q)
        full = end - begin >= np.maximum(s.least, s.times * q)
        found = np.concatenate([found, np.stack([begin[full], end[full], q[full]], 1)])
        found = found[np.lexsort(found.T[[2, 1, 0]])]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        found = found[new]
    return found[np.lexsort(found.T[[1, 2, 0]])]


def dropped(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each word stands in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(column: pa.Array, s: Settings = Settings()) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each text the number of words, its runs by start and period, and its words without the repetitions, joined by blanks."""
    data, bounds = common.text_bytes(column)
    start, end, doc = common.words_of(data, bounds)
    words = common.numbered(data[~common.IS_SPACE[data]], end - start)
    n = len(bounds) - 1
    n_words = np.bincount(doc, minlength=n)[:n]
    first = np.concatenate([[0], np.cumsum(n_words)])
    found = runs(doc, words.indices.to_numpy().astype(np.int64), s)
    owner = doc[found[:, 0]] if len(found) else np.zeros(0, np.int64)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n)[:n])])
    fields = [pa.array(found[:, 0] - first[owner]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])]
    listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN)))
    kept = np.flatnonzero(~dropped(len(doc), found))
    places = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=n)[:n])])
    texts = words.dictionary.cast(pa.large_string()).take(words.indices.take(pa.array(kept)))
    return pa.array(n_words), listed, pc.binary_join(pa.LargeListArray.from_arrays(pa.array(places), texts), pa.scalar(" ", pa.large_string()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of each text as (start, length, period) in words, by start and period, and the text without what repeats in them."""
    common.bounded_batches(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            n_words, listed, texts = find(part.column("text"), s)
            yield pa.RecordBatch.from_arrays([part.column("id"), n_words, listed, texts.cast(pa.string())], [id_col, "n_words", "runs", "collapsed"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(search, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
