import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.llm import subwords
from lectern.llm import weak_quality as W

from ..conftest import SF
from . import plain


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    n, k = 20_000, len(W.HEURISTICS)
    good = rng.random(n) < 0.85
    right = np.where(rng.random((n, k)) < np.where(good[:, None], 0.95, 0.7), good[:, None], ~good[:, None]).astype(int)
    votes = np.where(rng.random((n, k)) < 0.1, 2, right)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, table, prior = W.em(patterns, counts.astype(float))
    of = {tuple(x): y for x, y in zip(patterns, p)}
    guess = np.array([of[tuple(v)] >= 0.5 for v in votes])
    assert (guess == good).mean() > 0.98
    assert (table[:, 0, 0] > table[:, 1, 0] + 0.2).all()


def test_data_outweigh_the_expected_accuracies():
    """A heuristic that calls a third of the good texts bad is found out, given enough texts."""
    rng = np.random.default_rng(2)
    n, k = 200_000, len(W.HEURISTICS)
    good = rng.random(n) < 0.8
    votes = np.where(rng.random((n, k)) < np.where(good[:, None], 0.97, 0.8), good[:, None], ~good[:, None]).astype(int)
    votes[:, 3] = np.where(good & (rng.random(n) < 0.33), 0, good)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, table, _ = W.em(patterns, counts.astype(float))
    assert abs(table[3, 1, 0] - 0.33) < 0.02 and abs(table[0, 1, 0] - 0.03) < 0.01


def test_labels_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = W.classify(docs).join(labels, "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert sum(not r.kept for r in bad) / len(bad) > 0.9
    assert sum(r.kept for r in good) / len(good) > 0.98


def test_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("kept", F.lit(1))
    odd = spark.createDataFrame([(9_000, None), (9_001, ""), (9_002, "x " * 50_000), (None, "a")], "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    rows = W.classify(both).collect()
    assert len(rows) == both.count()
    scores = {r.doc_id: r.score for r in rows}
    assert scores[9_000] == scores[9_001]
    kept = W.keep_good(both)
    assert kept.columns == both.columns and kept.count() == sum(r.kept for r in rows)
    assert W.classify(docs.limit(0)).count() == 0


def test_long_varied_texts_keep_their_vote():
    place = list(W.HEURISTICS).index("variety")
    for n in (60, 700, 900, 2500, 20_000):
        codes = np.array([ord(c) for c in " ".join(f"w{i}" for i in range(n))])
        assert W.votes(W.figures(codes, np.array([0, len(codes)])))[0, place] == 1


def figures_of(text):
    words = [w for w in re.split("[ \t\n\v\f\r]+", text) if w]
    n, some = len(words), max(len(words), 1)
    letters, filled = sum(map(str.isalpha, text)), sum(map(len, words))
    marks = set("#*$%&|<>{}[]=~^_\\")
    count = lambda w: sum(map(str.isalpha, w))
    runs = lambda k: len({tuple(words[i : i + k]) for i in range(n - k + 1)})
    return [
        sum(c.isalpha() and c.isupper() for c in text) / max(letters, 1),
        sum(c in marks for c in text) / some,
        sum(a == b for a, b in zip(words, words[1:])) / some,
        len(set(words)) / min(some, 400) if n >= 50 else 0.3,
        filled / some,
        text.count("!") / some,
        letters / max(filled, 1),
        float(n),
        sum(not count(w) or not marks.isdisjoint(w) for w in words) / some,
        sum(count(w) >= len(w) - (w[-1] in ".,;:!?") for w in words) / some,
        sum(count(w) > 0 and len(w) <= 4 and count(w) <= 3 for w in words) / some if n >= 20 else 0.1,
        runs(2) / some if n >= 20 else 0.6,
        runs(3) / some if n >= 20 else 0.6,
    ]


def expected(scorer, text):
    s, found = scorer.settings, figures_of(text)
    grams = plain.buckets(text, s.orders, s.bits, lambda c: not plain.is_space(c))
    scale = [20, 20, 20, 20, 1, 20, 20, 0.2, 20, 20, 20, 20, 20]
    level = [math.floor(math.log1p(max(f, 0) * x) * 3) for f, x in zip(found, scale, strict=True)]
    shape = [scorer.weights[(plain.mix(v * 64 + j) >> (64 - s.bits)) + (1 << s.bits)] for j, v in enumerate(level)]
    x = sum(scorer.weights[b] for b in grams) / max(len(grams), 1) + sum(shape) / len(shape) + scorer.bias
    return 1 / (1 + math.exp(-x))


def test_every_row_against_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    scorer = W.fit(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = W.classify(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        score = expected(scorer, texts[r.doc_id])
        assert abs(r.score - score) < 1e-7, r
        assert r.kept == (r.score >= scorer.settings.least)


def test_figures_and_scores_do_not_depend_on_neighbours(spark):
    scorer = W.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    texts = ["", "a", "AA bb! AA bb!", "#tag {x} 12", "the of and to " * 30, "é ü\u00a0ß", " x"]
    found = W.figures(*subwords.code_points(pa.array(texts), False))
    assert np.allclose(found, [figures_of(t) for t in texts])
    together = scorer.score(pa.array(texts))
    assert np.allclose(together, [scorer.score(pa.array([t]))[0] for t in texts], atol=1e-12)
    assert np.allclose(together, [expected(scorer, t) for t in texts], atol=1e-9)
