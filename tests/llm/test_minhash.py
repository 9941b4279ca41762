import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, minhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    if not a or not b:
        return 0
    plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    wa, wb = ({x: 1 + np.log(c) for x, c in s.items()} for s in (a, b))
    every = wa.keys() | wb.keys()
    jp = sum(1 / sum(max(wa.get(y, 0) / wa[x], wb.get(y, 0) / wb[x]) for y in every) for x in wa.keys() & wb.keys())
    return max(plain, jp)


def classes(texts):
    found = [sets(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(found[i], found[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def corpus():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = [" ".join(word() for _ in range(int(n))) for n in rng.integers(1, 90, 25)]
    for i in range(25):
        w = texts[i].split()
        for k in (1, 3, 6):
            v = list(w)
            for p in rng.integers(0, len(v), k):
                v[p] = word()
            texts.append(" ".join(v))
    texts += [texts[0]] * 4 + ["say it again " * 30, "say it again " * 31, "  \n", "", None, "one two", "one  two"]
    base = [word() for _ in range(200)]
    for i in range(60):  # a family larger than a small bucket
        v = list(base)
        v[3 * i] = word()
        texts.append(" ".join(v))
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("class_id", F.lit("clash")).repartition(3)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_similarity_of_weighted_sets():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (Counter(rng.integers(0, 12, int(rng.integers(1, 30))).tolist()) for _ in range(2))
        flat = lambda s: (np.array(sorted(s), np.uint64), np.array([s[x] for x in sorted(s)], np.uint32))
        assert minhash.similarity(*flat(a), *flat(b)) == pytest.approx(alike(a, b))


def test_signatures_estimate():
    rng = np.random.default_rng(7)
    value = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    doc = np.concatenate([np.zeros(250, int), np.ones(250, int)])
    both = np.concatenate([value[:250], value[50:]])
    winner = minhash.signatures(doc, both, np.ones(500, int), 2, 4000)
    assert (winner[0] == winner[1]).mean() == pytest.approx(200 / 300, abs=0.03)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in minhash.near_duplicates(rows).collect()) == [(0, 0), (2, 2), (2, 2), (3, 3)]
    assert minhash.keep_first(rows).count() == 3  # of equal rows one stays; that without an id is in no group


def test_rows_that_share_an_id(spark):
    a, b = "one two three four five six seven", "quite another text that stands alone here"
    df = spark.createDataFrame([(1, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "z"), (7, a + "  ", "w"), (1, "  " + a, "v")], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (5, 1), (5, 5), (5, 5), (7, 1)]
    kept = minhash.keep_first(df).collect()
    assert sorted((r.doc_id, r.text.strip()) for r in kept) == [(1, a), (5, b)]
    # two texts of the smallest id are two groups
    two = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in minhash.keep_first(two).collect()) == [(1, a), (1, b)]
    named = spark.createDataFrame([("b", a), ("a", a), ("a", a)], "doc_id string, text string")
    assert [r.doc_id for r in minhash.keep_first(named).collect()] == ["a"]


def test_many_equal_rows_and_a_very_long_text(spark):
    long = " ".join(f"w{i % 7919}x{i}" for i in range(60_000))
    df = spark.createDataFrame([(3, "the same five words and more")] * 400 + [(4, long), (9, long + " end"), (5, "x" * 200_000)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in minhash.keep_first(df).collect()) == [3, 4, 5]


def test_repeats_do_not_hide_a_copy(spark):
    """Plain similarity is over 0.8 for all, the weighted one far below; only signatures that count a shingle once make such texts meet."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = []
    for _ in range(25):
        a = [word() for _ in range(100)]
        b = a[:50] + [word()] + a[50:] + a[:40] * 49
        texts += [" ".join(a), " ".join(b)]
    weights = [{x: 1 + np.log(c) for x, c in sets(t).items()} for t in texts[:2]]
    shared = weights[0].keys() & weights[1].keys()
    assert len(shared) / len(weights[0].keys() | weights[1].keys()) >= 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    want = classes(texts)
    assert sum(w != i for i, w in enumerate(want)) >= 20 and [got[i] for i in range(len(texts))] == want


def test_every_pair_of_a_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {i: sets(t) for i, t in texts.items()}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    ids, links = sorted(texts), 0
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if found[i].keys() & found[j].keys() and alike(found[i], found[j]) >= 0.8:
                links += 1
                assert got[i] == got[j]
    assert links >= 10


def test_pairs_in_a_large_family(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))

    def changed(words, k):
        out = list(words)
        for p in rng.choice(len(out), k, replace=False):
            out[p] = word()
        return out

    base = [word() for _ in range(304)]
    family = [changed(base, 9) for _ in range(600)]  # about 0.57 alike
    texts = [" ".join(x) for x in family + [changed(x, 6) for x in family[:60]]]
    found = [sets(t) for t in texts]
    data, bounds = minhash.common.text_bytes(minhash.pa.array(texts))
    doc, value, count, _, _ = minhash.shingles(data, bounds, 5)
    s = minhash.Settings(bands=4, rows=1, depth=1)  # few bands, so most pairs share only buckets that are large after the last level
    keys = minhash.band_keys(minhash.signatures(doc, value, count, len(texts), s.slots), s)
    planted = [(i, 600 + i) for i in range(60) if alike(found[i], found[600 + i]) >= 0.8 and (keys[i] == keys[600 + i]).any()]
    assert len(planted) > 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, s=s).collect()}
    assert len(set(got.values())) >= 600 and [p for p in planted if got[p[0]] != got[p[1]]] == []


def test_regular_words_are_told_apart():
    from .test_repetition import morse

    data, bounds = common.text_bytes(pa.array(list(morse(1024)) + [" ".join(t) for t in morse(1024)]))
    doc, value, _, _, whole = minhash.shingles(data, bounds, 5)
    assert len({tuple(k) for k in whole.tolist()}) == 4
    assert not set(value[doc == 0].tolist()) & set(value[doc == 1].tolist())
