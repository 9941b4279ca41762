import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hpylm

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_seating_follows_the_posterior():
    """Tables of n customers of one dish have the weights S(n, t) pull**t, S being generalised Stirling numbers."""
    rng = np.random.default_rng(0)
    for n, pull, d in ((2, 0.7, 0.5), (9, 0.3, 0.8), (60, 2.0, 0.5), (400, 3.0, 0.3)):
        log = np.full(n + 2, -np.inf)
        log[1] = 0.0
        for c in range(1, n):
            t = np.arange(1, n + 1)
            log[1 : n + 1] = np.logaddexp(log[:n], log[1 : n + 1] + np.log(np.maximum(c - t * d, 1e-300)))
        weight = log[1 : n + 1] + np.arange(1, n + 1) * math.log(pull)
        weight = np.exp(weight - weight.max())
        want = (weight * np.arange(1, n + 1)).sum() / weight.sum()
        # the discount of the restaurant's own new tables is left out here: a fixed pull
        got = hpylm.seat(np.full(4000, n), np.full(4000, 1e9), np.full(4000, pull / 1e9), 0.0, d, rng).mean()
        assert got == pytest.approx(want, rel=0.08)
    assert hpylm.seat(np.array([0, 1, 5]), np.ones(3), np.array([1.0, 1.0, 0.0]), 0.0, 0.5, rng).tolist() == [0, 1, 1]


def cells_of(words):
    symbol, slot, bounds = hpylm.symbols(words)
    cells = Counter((slot * hpylm.SYMBOLS + symbol).tolist())
    cell = np.array(sorted(cells), np.int64)
    return cell // hpylm.SYMBOLS, cell % hpylm.SYMBOLS, np.array([cells[c] for c in cell.tolist()])


def test_spelling_sums_to_one():
    words = [b"abab", b"aba", b"b", b""]
    symbol, slot, bounds = hpylm.symbols(words)
    model = hpylm.sample_spelling(*cells_of(words), hpylm.Settings(), 0)
    for context in np.unique(slot).tolist():
        at = np.arange(1, hpylm.SYMBOLS)
        one = model.log10(at, np.full(len(at), context), np.arange(len(at) + 1))
        assert (10**one).sum() == pytest.approx(1, abs=1e-5)
    whole = model.log10(symbol, slot, bounds)
    assert whole[1] > whole[0] - 20 and (whole < 0).all()


def test_sweeps_follow_gibbs_sampling_customer_by_customer():
    """Three words in two contexts over a fixed base: mean tables against a sampler that moves one customer at a time."""
    s, d = hpylm.Settings(), (0.6, 0.5)
    counts = {(0, 0): 9, (0, 1): 3, (1, 0): 30, (1, 1): 4, (2, 0): 1, (2, 1): 6}
    base = np.array([0.2, 0.05, 0.01])
    rng = np.random.default_rng(4)
    # plain: each cell's tables as lists of sizes, in contexts and in the word restaurant
    cell = {k: [1] * n for k, n in counts.items()}
    word = {w: [1] * sum(counts[w, g] for g in (0, 1)) for w in range(3)}

    def share(w):
        n, t = sum(map(sum, word.values())), sum(map(len, word.values()))
        return (sum(word[w]) - d[1] * len(word[w]) + (1 + d[1] * t) * base[w]) / (1 + n)

    def sit(tables, pull, discount):
        weights = np.array([x - discount for x in tables] + [pull])
        i = rng.choice(len(weights), p=weights / weights.sum())
        if i == len(tables):
            tables.append(0)
        tables[i] += 1
        return tables[i] == 1

    def leave(tables):
        i = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[i] -= 1
        if not tables[i]:
            tables.pop(i)
            return True
        return False

    plain = []
    for k in range(1500):
        for (w, g), n in counts.items():
            for _ in range(n):
                if leave(cell[w, g]):
                    leave(word[w])
                open_ = sum(len(cell[x, g]) for x in range(3))
                if sit(cell[w, g], (1 + d[0] * open_) * share(w), d[0]):
                    sit(word[w], (1 + d[1] * sum(map(len, word.values()))) * base[w], d[1])
        if k >= 100:
            plain.append([len(cell[c]) for c in counts] + [len(word[w]) for w in range(3)])
    of, at = (np.array(x) for x in zip(*counts, strict=True))
    count = np.array(list(counts.values()))
    many = count > 1
    singles = np.bincount(of[~many], minlength=3)
    tables, customers, seated = np.ones(3), singles + np.bincount(of[many], minlength=3), np.ones(many.sum())
    opened, got = np.bincount(at).astype(float), []
    for k in range(6000):
        t = hpylm.Totals(opened, customers.sum(), tables.sum(), *d)
        seated, customers, tables = hpylm.seat_words(of[many], at[many], count[many], seated, singles, customers, tables, np.log10(base), t, s, rng)
        opened = np.bincount(at[~many], minlength=2) + np.bincount(at[many], seated, 2)
        if k >= 200:
            full = np.ones(len(count))
            full[many] = seated
            got.append([*full, *tables])
    assert np.mean(got, 0) == pytest.approx(np.mean(plain, 0), rel=0.25, abs=0.15)  # few customers, so that each weighs much, are the hardest case


def test_scores_are_those_of_a_plain_model(spark):
    """Every word and every pair comes once in training, so all seats are known; the rest is arithmetic."""
    s = hpylm.Settings()
    texts = {1: "one Two three four five", 3: "two one unseen", 4: "", 5: "five", 6: "one two three"}
    held = {3, 4, 5, 6}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in hpylm.score(df, F.col("doc_id").isin(*held)).collect()}
    words = {i: [w.lower().encode() for w in t.split()] + [b""] for i, t in texts.items()}
    class_of = lambda w: int(hpylm.common.mix(np.array([zlib.crc32(w)], np.uint64) * hpylm.common.BASE + np.uint64(9))[0] >> np.uint64(64 - hpylm.CONTEXT_BITS))
    pairs = {(class_of(a), b) for a, b in zip([b"", *words[1]], words[1])}
    at, known, n, d = Counter(g for g, _ in pairs), sorted(words[1]), len(pairs), 0.95
    assert n == len(known) == 6
    models = [hpylm.sample_spelling(*cells_of(known), s, k) for k in range(s.burn_in, s.burn_in + s.samples)]

    def p(w):
        return np.mean([((w in known) * (1 - d) + (1 + d * n) * 10 ** m.log10(*hpylm.symbols([w]))[0]) / (1 + n) for m in models])

    for i, ws in words.items():
        total = 0
        for a, b in zip([b"", *ws], ws):
            g = class_of(a)
            total += math.log10((((g, b) in pairs) * (1 - d) + (1 + d * at[g]) * p(b)) / (1 + at[g]))
        assert rows[i].score == pytest.approx(total, rel=1e-5)
        assert rows[i].perplexity == pytest.approx(10 ** (-rows[i].score / len(ws)))


def test_base_scores_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(7_000, None), (7_001, ""), (7_002, "A a É"), (None, "the of"), (7_003, "of the " * 30_000), (7_004, "x" * 5000), (7_002, "A a É")], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", F.lit("clash"))
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    found = hpylm.score(docs, held).collect()
    rows = {r.doc_id: r for r in found}
    texts = {r.doc_id: (r.text or "", r.held) for r in docs.withColumn("held", F.coalesce(held, F.lit(False))).collect()}
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, (t, _) in texts.items()}
    count = Counter(w for i, ws in tokens.items() if not texts[i][1] for w in ws)
    if not texts[7_002][1]:
        count.update(tokens[7_002])  # it is there twice
    n, v = sum(count.values()), len(count)
    gain = 0
    assert len(found) == docs.count() and len(rows) == len(texts)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (texts[i][1], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0 and math.isfinite(r.score)
        gain += r.score - r.base_score if r.held_out and r.n_known == len(ws) else 0
    assert gain > 0  # of known words only, as the base gives all unseen words the share of one
    assert rows[7_000].score == rows[7_001].score
    assert len({r.score for r in found if r.doc_id == 7_002}) == 1


def test_order_counts_and_copies_stand_out(spark):
    rng = np.random.default_rng(0)
    say = lambda: " ".join(rng.choice([f"w{i}" for i in range(300)], 60))
    texts = [say() for _ in range(200)]
    texts += [texts[0], " ".join(reversed(texts[0].split()))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in hpylm.score(df, F.col("doc_id") == 201).collect()}
    assert rows[0].score == rows[200].score > max(rows[i].score for i in range(1, 200))
    assert rows[201].base_score == pytest.approx(rows[0].base_score) and rows[201].score < rows[0].score - 30


def test_hot_buckets_are_met_in_parts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3, "doc_id")
    held = F.col("doc_id") % 5 == 0
    monkeypatch.setattr(hpylm, "BLOCK_BYTES", 30_000)
    whole = {tuple(r) for r in hpylm.score(docs, held).collect()}
    monkeypatch.setattr(hpylm, "MEET_BYTES", 300)
    assert whole == {tuple(r) for r in hpylm.score(docs, held).collect()}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in hpylm.score(docs, F.lit(True)).collect()}
    assert rows[1].base_score == 0 and rows[1].train_tokens == 0 and rows[1].n_known == 0
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows.values())
    assert hpylm.score(docs.limit(0), F.lit(False)).count() == 0
