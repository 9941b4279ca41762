"""Quality rules: repeated passages of a text by a suffix array over its words.

The suffix array of the words of each text is sorted by rank doubling, many texts
at once. An interval of the array whose suffixes share a prefix of l words is a
repeated substring with all its places; the longest such prefix at a place is the
larger of the common prefixes with its two neighbours, so the union of the spans
of all intervals of at least ``min_words`` words is the union over the places of
``[place, place + that length)``. Words and lines are told apart exactly, and the common
prefixes are read from the names of blocks of words (``periodic.Names``). A text is rejected if the union covers too large
a share of its words, or if the longest repeat is too long.

Nulls count as empty texts, which the base rule rejects (fewer than ``min_total``
words); other columns are never read, so their names cannot clash; equal rows get
equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .periodic import Names

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits: words in all, words of a repeat that counts, per cent of words in repeats, words and per cent of the longest repeat."""

    min_total: int = 10
    min_words: int = 5
    max_covered: int = 20
    max_longest: int = 50
    max_longest_share: int = 10


def suffix_array(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places in the order of the suffixes of their texts, text by text.

    Ranks are the first place of a group of equal prefixes; only groups of more
    than one place are sorted again, by the rank that stands as many words further.
    """
    n = len(word)
    ids = np.unique(word, return_inverse=True)[1]
    key = doc.astype(np.int64) * (ids.max() + 1 if n else 1) + ids
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def heads(sorted_keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        new = np.ones(len(sorted_keys), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        return at[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]

    rank[order] = heads(key[order], np.arange(n))
    end = np.searchsorted(doc, doc, "right") if n else doc
    step, open_at = 1, np.arange(n)
    while True:
        ranks = rank[order[open_at]]
        alone = np.ones(len(open_at), bool)
        same = ranks[1:] == ranks[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        open_at = open_at[~alone]
        if not len(open_at):
            return order
        place = order[open_at]
        after = np.where(place + step < end[place], rank[np.minimum(place + step, n - 1)] + 1, 0)
        keys = rank[place] * (n + 1) + after
        inner = np.argsort(keys, kind="stable")
        order[open_at] = place[inner]
        rank[place[inner]] = heads(keys[inner], open_at)
        step *= 2


def longest_repeats(doc: np.ndarray, word: np.ndarray, least: int) -> np.ndarray:
    """For each place the words of the longest string from there that also starts elsewhere in its text; 0 below ``least``."""
    n = len(word)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = suffix_array(doc, word)
    names = Names(doc * (int(word.max()) + 1) + word)
    p, q = order[:-1], order[1:]
    near = (doc[p] == doc[q]) & (names.levels[0][p] == names.levels[0][q])
    p, q = p[near], q[near]
    shared = names.after(np.minimum(p, q), np.maximum(p, q))
    full = shared >= least
    np.maximum.at(out, p[full], shared[full])
    np.maximum.at(out, q[full], shared[full])
    return out


def measure(column: pa.Array, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """The figures and verdicts of a column of texts."""
    data, bounds = common.text_bytes(column)
    n = len(bounds) - 1
    start, end, doc = common.words_of(data, bounds)
    word = common.numbered(data[~common.IS_SPACE[data]], end - start).indices.to_numpy().astype(np.int64)
    n_words = np.bincount(doc, minlength=n)[:n]
    inner = ~common.IS_SPACE[data]
    word_chars = common.per_doc(common.running(inner & common.STARTS_CHAR[data]), bounds)
    n_symbols = common.per_doc(common.running(IS_SYMBOL[data]), bounds)

    cuts = np.flatnonzero(data == 10)
    begin = np.union1d(bounds[:-1], cuts + 1)
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    line_doc = np.searchsorted(bounds, begin, "right") - 1
    held = common.running(inner)
    stop = stop - (data[stop - 1] == 10) if len(begin) else stop
    full = held[stop] > held[begin]
    line = common.numbered(data[data != 10], stop - begin).indices.to_numpy().astype(np.int64)[full]
    line_doc = line_doc[full]
    first = np.unique(line_doc * (int(line.max(initial=0)) + 1) + line, return_index=True)[1]
    n_dup_lines = np.bincount(line_doc, minlength=n)[:n] - np.bincount(line_doc[first], minlength=n)[:n]

    longest = longest_repeats(doc, word, rules.min_words)
    at = np.flatnonzero(longest)
    change = np.zeros(len(word) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    covered = np.cumsum(change[:-1]) > 0
    n_repeat = np.bincount(doc[covered], minlength=n)[:n]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc, longest)
    failed = (n_words < rules.min_total) | (100 * n_repeat > rules.max_covered * n_words)
    too_long = (most > rules.max_longest) & (100 * most > rules.max_longest_share * n_words)
    kept = ~failed & ~too_long
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "longest_repeat": most, "base_failed": failed, "kept": kept}


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: the id, the figures and the verdict."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text_col):
            found = measure(part.column(text_col), rules)
            yield pa.RecordBatch.from_arrays([part.column(id_col), *map(pa.array, found.values())], [id_col, *found])

    return common.map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {FIGURES}")


def keep_good(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text_col):
            yield part.filter(pa.array(measure(part.column(text_col), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
