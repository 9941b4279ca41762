"""Language identification: averaged hashed subword embeddings and a linear softmax.

The model is fitted on the driver by stochastic gradient descent in numpy from a
bounded sample (``per_language`` texts of each language in expectation, by a hash
of the id); only bucket counts of the sampled texts travel. A fifth of the sample
sets a temperature that calibrates the probabilities, and the least probability at
which at most ``max_error`` of the accepted texts of that part are wrong; a text
below it is marked ``rejected``.

Null texts and texts without a letter are ``und`` with score 0. If no row can be
learned from, all texts are. Other columns are never read; ties between languages
go to the first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, subwords


@dataclass(frozen=True)
class Settings:
    per_language: int = 600
    orders: tuple[int, ...] = (1, 2, 3, 4)
    bits: int = 13
    size: int = 16
    epochs: int = 20
    batch: int = 32
    rate: float = 2.0
    max_error: float = 0.01
    seed: int = 7


@dataclass
class Model:
    langs: list[str]
    embeddings: np.ndarray
    softmax: np.ndarray
    temperature: float
    least: float
    settings: Settings

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and whether it was rejected."""
        codes, bounds = subwords.code_points(column, True)
        has = common.per_doc(common.running((subwords.kinds()[codes] & subwords.LETTER) > 0), bounds) > 0
        if not self.langs:
            return ["und"] * len(has), np.zeros(len(has)), np.ones(len(has), bool)
        # the mean of embeddings times a matrix is the mean of rows of their product
        sums, counts = subwords.doc_sums(codes, bounds, self.embeddings @ self.softmax, self.settings.orders, self.settings.bits, True)
        p = softmax(sums / np.maximum(counts, 1)[:, None] / self.temperature)
        best = p.argmax(1)
        score = np.where(has, p[np.arange(len(p)), best], 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], score, ~has | (score < self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, s: Settings) -> list[tuple]:
    """(id, language, buckets, counts) of the sampled texts, in order of the id's hash."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return []
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, s.per_language / n))])
    drawn = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    some = rows.where(F.pmod(drawn, F.lit(1_000_000)) < rate[F.col(lang_col)] * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            found = subwords.doc_counts(*subwords.code_points(part.column("text"), True), s.orders, s.bits, True)
            yield pa.RecordBatch.from_arrays([part.column("drawn"), part.column("lang"), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), pa.array([b.tolist() for _, b in found], pa.list_(pa.int32()))], ["drawn", "lang", "buckets", "counts"])

    cols = [drawn.alias("drawn"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")]
    out = some.select(*cols).mapInArrow(run, "drawn long, lang string, buckets array<int>, counts array<int>").toArrow()
    return sorted(zip(*(out.column(i).to_pylist() for i in range(4)), strict=True))


def fit(rows: list[tuple], s: Settings = Settings()) -> Model:
    langs = sorted({r[1] for r in rows})
    width, rng = 1 << s.bits, np.random.default_rng(s.seed)
    e = rng.normal(0, 0.1, (width, s.size)).astype(np.float32)
    w = np.zeros((s.size, len(langs)), np.float32)
    y = np.array([langs.index(r[1]) for r in rows], int)
    x = [(np.array(r[2], np.int64), np.array(r[3], np.float32)) for r in rows]
    check = np.arange(len(rows)) % 5 == 4
    train, tune = np.flatnonzero(~check), np.flatnonzero(check)
    steps, done = s.epochs * -(-len(train) // s.batch), 0
    for _ in range(s.epochs):
        order = rng.permutation(train)
        for i in range(0, len(order), s.batch):
            part = order[i : i + s.batch]
            m = subwords.dense([x[j] for j in part], width)
            hidden = m @ e
            wrong = softmax(hidden @ w)
            wrong[np.arange(len(part)), y[part]] -= 1
            pace = s.rate * (1 - done / steps)
            back = wrong @ w.T
            w -= pace * hidden.T @ wrong / len(part)
            e -= pace * 50 * (m.T @ back) / len(part)
            done += 1
    model = Model(langs, e, w, 1.0, 0.0, s)
    if len(tune) and langs:
        logits = np.concatenate([subwords.dense([x[j] for j in tune[i : i + 256]], width) @ e @ w for i in range(0, len(tune), 256)]).astype(float)
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(tune)), y[tune]] + 1e-12).mean()
        model.temperature = min(np.geomspace(0.05, 20, 61), key=loss)
        p = softmax(logits / model.temperature)
        sure, right = p.max(1), p.argmax(1) == y[tune]
        down = np.argsort(-sure, kind="stable")
        error = np.cumsum(~right[down]) / np.arange(1, len(down) + 1)
        fine = np.flatnonzero(error <= s.max_error)
        model.least = float(sure[down][fine[-1]]) if len(fine) else 1.0
        if len(fine) == len(down):
            model.least = min(model.least, 0.5)
    return model


def identify(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", s: Settings = Settings()) -> DataFrame:
    """(id, lang_pred, score, rejected) of every text; learned from the rows where ``usable`` holds."""
    common.bounded_batches(docs.sparkSession)
    model = fit(sample(docs, usable, id_col, text_col, lang_col, s), s)
    spread = docs.sparkSession.sparkContext.broadcast(model)  # of a size that the settings fix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, text_col):
            lang, score, rejected = spread.value.predict(part.column(text_col))
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(lang), pa.array(score), pa.array(rejected)], [id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
