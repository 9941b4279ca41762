"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each text. Expectation
maximisation over the counts of vote patterns of *all* documents (there are at most
three to the power of the heuristics) estimates how each heuristic votes on good
and on bad texts, and so each pattern's posterior. The posteriors label a bounded
sample (``per_class`` texts a class in expectation), from which a hashed linear
scorer is trained; the scorer alone judges all texts.

Nulls count as empty texts; an empty text has no feature but its length and is
judged by that. Other columns are never read; equal texts get equal scores; an
empty table fits no model and yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, subwords

IS_MARK = np.zeros(0x110000, bool)
IS_MARK[[ord(c) for c in "#*$%&|<>{}[]=~^_\\"]] = True

IS_STOP = np.zeros(0x110000, np.int64)
IS_STOP[[ord(c) for c in ".,;:!?"]] = 1

#: Heuristic: bad from, bad to, good from, good to, as intervals of its figure; anything else is no vote.
HEURISTICS = {
    "shouting": (0.5, 2.0, 0.0, 0.2),
    "marks": (0.2, 1e9, -1.0, 0.05),
    "stutter": (0.2, 2.0, -1.0, 0.05),
    "variety": (-1.0, 0.2, 0.35, 1e18),
    "word_length": (14.0, 1e9, 2.5, 8.0),
    "exclaims": (0.2, 1e9, -1.0, 0.06),
    "letters": (-1.0, 0.7, 0.85, 2.0),
    "length": (-1.0, 1.5, 19.5, 1e18),
    "odd_words": (0.3, 2.0, -1.0, 0.05),
    "plain_words": (-1.0, 0.55, 0.85, 2.0),
    "small_words": (-1.0, 0.02, 0.15, 0.7),
    "pairs": (-1.0, 0.4, 0.7, 2.0),
    "triples": (-1.0, 0.4, 0.8, 2.0),
}

#: How a heuristic that votes is expected to vote on bad and on good texts before any is seen: bad, good. It keeps the classes from changing places
#: and weighs as much as so many bad and good texts, however many there are.
EXPECTED, WEIGHT = ((0.5, 0.5), (0.01, 0.99)), (50, 200)


@dataclass(frozen=True)
class Settings:
    per_class: int = 2000
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 13
    epochs: int = 15
    batch: int = 32
    rate: float = 0.5
    decay: float = 1e-6
    least: float = 0.3
    seed: int = 11


def figures(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A column for each heuristic."""
    flags = subwords.kinds()[codes]
    per = lambda f: common.per_doc(common.running(f), bounds)
    inner = (flags & subwords.SPACE) == 0
    begin = inner.copy()
    begin[1:] &= ~inner[:-1]
    stop = inner.copy()
    stop[:-1] &= ~inner[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    word = common.Rolling(common.mix(codes.astype(np.uint64) * common.BASE + np.uint64(3))).segment(start, end)
    n = len(bounds) - 1
    words = np.bincount(doc, minlength=n)[:n]

    def distinct(k: int) -> np.ndarray:
        """Different runs of k words in each text."""
        key = word.copy()
        for i in range(1, k):
            key = key[: max(len(word) - i, 0)] * subwords.STEP + word[i:]
        at = np.flatnonzero(doc[: len(key)] == doc[k - 1 :])
        key = common.mix(key[at] + doc[at].astype(np.uint64) * common.BASE)
        return np.bincount(doc[at[np.unique(key, return_index=True)[1]]], minlength=n)[:n]

    kinds_of_word = distinct(1)
    twice = np.bincount(doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])], minlength=n)[:n]
    in_word = lambda f: (c := common.running(f))[end] - c[start]
    by_word = lambda f: np.bincount(doc[f], minlength=n)[:n]
    letter_count = in_word((flags & subwords.LETTER) > 0)
    lettered, marked = letter_count > 0, in_word(IS_MARK[codes]) > 0
    plain = letter_count >= end - start - IS_STOP[codes[np.maximum(end - 1, 0)]]
    letters, filled, some = per((flags & subwords.LETTER) > 0), per(inner), np.maximum(words, 1)
    return np.stack([
        per((flags & subwords.UPPER) > 0) / np.maximum(letters, 1),
        per(IS_MARK[codes]) / some,
        twice / some,
        np.where(words >= 50, kinds_of_word / np.minimum(some, 400), 0.3),
        filled / some,
        per(codes == ord("!")) / some,
        letters / np.maximum(filled, 1),
        words.astype(float),
        by_word(~lettered | marked) / some,
        by_word(plain) / some,
        np.where(words >= 20, by_word(lettered & (end - start <= 4) & (letter_count <= 3)) / some, 0.1),
        np.where(words >= 20, distinct(2) / some, 0.6),
        np.where(words >= 20, distinct(3) / some, 0.6),
    ], 1)


def votes(found: np.ndarray) -> np.ndarray:
    """0 bad, 1 good, 2 none."""
    out = np.full(found.shape, 2, np.int8)
    for j, (low, high, fine, best) in enumerate(HEURISTICS.values()):
        out[(found[:, j] >= low) & (found[:, j] <= high), j] = 0
        out[(found[:, j] >= fine) & (found[:, j] <= best), j] = 1
    return out


def codes_of(vote: np.ndarray) -> np.ndarray:
    return vote.astype(np.int64) @ (3 ** np.arange(vote.shape[1]))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, P(vote | class, it votes) for each heuristic, and the share of good texts.

    That a heuristic has no vote says nothing about a text.
    """
    bad = (patterns == 0).sum(1)
    p = np.where(bad >= 2, 0.05, np.where(bad == 1, 0.6, 0.98))
    table, prior, total = np.zeros((patterns.shape[1], 2, 2)), 0.5, counts.sum()
    for _ in range(rounds):
        prior = float((p * counts).sum() / total)
        for j in range(patterns.shape[1]):
            for v in (0, 1):
                at = patterns[:, j] == v
                table[j, 1, v] = (p * counts)[at].sum() + EXPECTED[1][v] * WEIGHT[1]
                table[j, 0, v] = ((1 - p) * counts)[at].sum() + EXPECTED[0][v] * WEIGHT[0]
        table /= table.sum(2, keepdims=True)
        log = np.log(np.array([max(1 - prior, 1e-9), max(prior, 1e-9)]))[None, :].repeat(len(patterns), 0)
        for j in range(patterns.shape[1]):
            cast = np.flatnonzero(patterns[:, j] < 2)
            log[cast] += np.log(table[j][:, patterns[cast, j]]).T
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return p, table, prior


def shape_buckets(found: np.ndarray, bits: int) -> np.ndarray:
    """A bucket for each figure's level, beside those of the n-grams."""
    level = np.floor(np.log1p(np.maximum(found, 0) * np.array([20, 20, 20, 20, 1, 20, 20, 0.2, 20, 20, 20, 20, 20])) * 3).astype(np.uint64)
    return (common.mix(level * np.uint64(64) + np.arange(found.shape[1], dtype=np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    settings: Settings

    def score(self, column: pa.Array) -> np.ndarray:
        s, (codes, bounds) = self.settings, subwords.code_points(column, False)
        sums, counts = subwords.doc_sums(codes, bounds, self.weights[: 1 << s.bits, None], s.orders, s.bits, False)
        shape = self.weights[shape_buckets(figures(codes, bounds), s.bits)].mean(1)
        return 1 / (1 + np.exp(-np.clip(sums[:, 0] / np.maximum(counts, 1) + shape + self.bias, -500, 500)))


def train(rows: list[tuple], s: Settings) -> Scorer:
    """rows: (order, posterior, buckets, counts, shape buckets)."""
    width, rng = 2 << s.bits, np.random.default_rng(s.seed)
    w, seen, bias = np.zeros(width), np.full(width, 1e-6), 0.0
    y = np.array([r[1] for r in rows])
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).mean(), 1e-9), 0.5 / max((y < 0.5).mean(), 1e-9)) if len(y) else y
    for _ in range(s.epochs):
        for part in np.array_split(order := rng.permutation(len(rows)), max(1, len(order) // s.batch)):
            if not len(part):
                continue
            x = subwords.dense([(np.array(rows[j][2], np.int64), np.array(rows[j][3], float)) for j in part], width)
            for i, j in enumerate(part):
                np.add.at(x[i], np.array(rows[j][4], np.int64), 1 / len(HEURISTICS))
            wrong = weight[part] * (1 / (1 + np.exp(-np.clip(x @ w + bias, -500, 500))) - y[part]) / len(part)
            step = x.T @ wrong + s.decay * w
            seen += step * step
            w -= s.rate * step / np.sqrt(seen)
            bias -= s.rate * float(wrong.sum())
    return Scorer(w, bias, s)


def _rows(got: pa.Table) -> list[tuple]:
    """The drawn texts in an order of their own, their lists as views of arrays."""
    if not got.num_rows:
        return []
    drawn, posterior = (got.column(c).to_numpy() for c in ("drawn", "posterior"))
    lists = []
    for c in ("buckets", "counts", "shape"):
        column = got.column(c).chunk(0)
        values, cuts = column.values.to_numpy(), column.offsets.to_numpy().tolist()
        lists.append([values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    mark = np.array([float(b.astype(float) @ c) for b, c in zip(lists[0], lists[1], strict=True)])
    return [(drawn[i], posterior[i], lists[0][i], lists[1][i], lists[2][i]) for i in np.lexsort((mark, posterior, drawn)).tolist()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> Scorer | None:
    """The trained scorer; None for an empty table."""
    common.bounded_batches(docs.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            code = codes_of(votes(figures(*subwords.code_points(part.column("text"), False))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(code, return_counts=True)], ["pattern", "n"])

    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("drawn"))
    seen = texts.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not seen:
        return None
    seen = sorted((r.pattern, r.n) for r in seen)
    code, counts = np.array([x for x, _ in seen]), np.array([x for _, x in seen], float)
    patterns = code[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3
    posterior, _, _ = em(patterns, counts)
    of = dict(zip(code.tolist(), posterior.tolist(), strict=True))
    size = [max(1.0, counts[(posterior >= 0.5) == c].sum()) for c in (False, True)]
    rate = [min(1.0, s.per_class / x) for x in size]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            drawn = (part.column("drawn").to_numpy() % 1_000_000) / 1_000_000
            part = part.filter(pa.array(drawn < max(rate)))
            drawn = drawn[drawn < max(rate)]
            if not part.num_rows:
                continue
            codes, bounds = subwords.code_points(part.column("text"), False)
            found = figures(codes, bounds)
            p = np.array([of[c] for c in codes_of(votes(found)).tolist()])
            take = drawn < np.where(p >= 0.5, rate[1], rate[0])
            grams, shape = subwords.doc_counts(codes, bounds, s.orders, s.bits, False), shape_buckets(found, s.bits)
            at = np.flatnonzero(take).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(drawn[at]), pa.array(p[at]), *[pa.array([x[i] if k < 0 else x[i][k].tolist() for i in at], pa.list_(pa.int32())) for x, k in ((grams, 0), (grams, 1), (shape.tolist(), -1))]], ["drawn", "posterior", "buckets", "counts", "shape"])

    got = texts.mapInArrow(draw, "drawn double, posterior double, buckets array<int>, counts array<int>, shape array<int>").toArrow()
    return train(_rows(got.combine_chunks()), s)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, score, kept) of every document."""
    spread = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, s))  # of a size that the settings fix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text_col):
            score = spread.value.score(part.column(text_col))
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(score), pa.array(score >= s.least)], [id_col, "score", "kept"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, kept boolean")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The documents that the scorer keeps, with all their columns."""
    spread = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text_col):
            yield part.filter(pa.array(spread.value.score(part.column(text_col)) >= s.least))

    return docs.mapInArrow(run, docs.schema)
