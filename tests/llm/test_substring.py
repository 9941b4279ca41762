import dataclasses
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import sais, substring


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = True
        covered = covered[:-1] if len(t) else covered[:0]
        starts = int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if len(t) else 0
        kept = bytes(b for b, c in zip(t, covered) if not c)
        out.append((len(t), int(covered.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("large", [3, 2000])
def test_suffix_arrays(monkeypatch, large):
    monkeypatch.setattr(sais, "LARGE", large)
    monkeypatch.setattr(sais, "SHORT", large // 3 - 1)  # 0 or 665: no text or all texts of names
    rng = np.random.default_rng(0)
    for i in range(300):
        text = np.append(rng.integers(1, rng.choice([2, 5, 30, 9000]), rng.integers(0, 90)), 0)
        text = np.concatenate([text[:-1], text]) if i % 3 == 0 else text
        assert sais.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_common_prefixes_go_no_further_than_a_string():
    rng = np.random.default_rng(8)
    for trial in range(60):
        parts = [rng.integers(2, 4 + trial % 3, rng.integers(1, 30)).tolist() for _ in range(5)]
        parts += parts[:2] + [[2] * 20, [2, 3] * 12]
        text = np.array([x for p in parts for x in [*p, 1]])
        ends = np.cumsum([len(p) + 1 for p in parts])
        left = np.repeat(ends - 1, np.diff(np.append(0, ends))) - np.arange(len(text))
        order, most = sais.suffix_array(np.append(text, 0))[1:], int(rng.integers(1, 40))
        got = sais.common_prefixes(text, order, left, most)
        for i, j in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            n = 0
            while n < min(left[i], left[j]) and text[i + n] == text[j + n]:
                n += 1
            assert got[i] == min(n, most)
        assert got[order[0]] == 0


def corpus():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdé"), 4))
    passage = " ".join(word() for _ in range(12))
    texts = [" ".join(word() for _ in range(int(n))) for n in rng.integers(0, 60, 40)]
    texts += [f"{texts[i]} {passage} {texts[i + 1]}" for i in range(10)]
    texts += [passage[k : k + 40] + word() for k in range(0, 20, 3)] + [texts[3], texts[3], "ab" * 80, "z" * 90, "", None]
    return texts


def passage_words(texts, length):
    """Words of each text in word windows that also start elsewhere."""
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    return [len({i + j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(length)}) for w in words]


@pytest.mark.parametrize("most", [2, 256])
def test_against_brute_force(spark, most):
    texts = corpus()
    s = substring.Settings(length=30, anchor=10, shard_strings=most, pieces=(5, 1), batch_bytes=500)
    of_words = substring.Settings(length=6, anchor=2, words=True, shard_strings=most, pieces=(2, 1), batch_bytes=500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = [tuple(r)[1:] for r in substring.digest(df, s=s, passages=of_words).orderBy("doc_id").collect()]
    data = [(t or "").encode() for t in texts]
    assert got == [(*x, n) for x, n in zip(brute(data, 30), passage_words(data, 6), strict=True)]


def without_repeats(texts, length):
    """Each text's words without windows that start in an earlier text, or earlier in the same one."""
    seen, out = set(), []
    for t in texts:
        words, gone = (t or "").encode().split(), set()
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if key in seen:
                gone |= set(range(i, i + length))
            seen.add(key)
        out.append([w for i, w in enumerate(words) if i not in gone])
    return out


@pytest.mark.parametrize("most", [2, 256])
def test_the_first_place_stays(spark, most):
    texts = corpus()
    s = substring.Settings(length=6, anchor=2, words=True, first_stays=True, shard_strings=most, pieces=(2, 1), batch_bytes=500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text or "").encode().split() for r in substring.cleaned(df, s=s).collect()}
    want = without_repeats(texts, 6)
    # a document of which nothing is left goes, one that was empty stays
    assert set(got) == {i for i, t in enumerate(texts) if want[i] or not t}
    assert all(got[i] == want[i] for i in got)


def test_a_short_worded_passage_of_51_words(spark):
    rng = np.random.default_rng(1)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))
    passage, short = say(51), say(50)
    assert len(passage) < 400
    texts = [f"{say(30)} {passage}\n{say(20)}", f"{say(9)}  {passage} {say(9)}", f"{passage}", f"{say(5)} {short} {say(5)}", f"{short} {say(5)}"]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in substring.cleaned(df, s=dataclasses.replace(substring.PASSAGES, first_stays=True)).collect()}
    assert sorted(rows) == [0, 1, 3, 4] and all(rows[i].text == texts[i] for i in (0, 3, 4))
    assert passage not in rows[1].text and len(rows[1].text.split()) == 18 and rows[1].n_chars == len(rows[1].text)
    assert [r.n_passage_words for r in substring.digest(df).orderBy("doc_id").collect()] == [51, 51, 51, 0, 0]


def test_cleaned_and_edges(spark):
    texts = corpus()
    s = substring.Settings(length=30, anchor=10)
    df = spark.createDataFrame([(i, t, "x", len(t or ""), 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long, k int")
    out = substring.cleaned(df, s=s)
    assert out.columns == df.columns
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert substring.digest(df.limit(0), s=s).count() == 0
    # equal rows repeat each other; rows that share an id but not the text stay apart; null ids are rows like others
    twice = spark.createDataFrame([(1, "q" * 3 + "abcdefghij" * 4), (1, "q" * 3 + "abcdefghij" * 4), (1, "other text that is alone here, long enough"), (None, "one more text without an id, long enough")], "doc_id long, text string")
    rows = sorted((r.n_bytes, r.n_removed) for r in substring.digest(twice, s=s).collect())
    assert rows == [(40, 0), (42, 0), (43, 43), (43, 43)]
    # where the first place stays, they are one place
    kept = sorted(len(r.text) for r in substring.cleaned(twice, size_col=None, s=dataclasses.replace(s, first_stays=True)).collect())
    assert kept == [13, 13, 40, 42]  # the second half of what repeats within a text goes
    named = spark.createDataFrame([("b", "the same words here " * 2), ("a", "the same words here " * 2)], "doc_id string, text string")
    assert [r.doc_id for r in substring.cleaned(named, size_col=None, s=dataclasses.replace(s, first_stays=True)).collect()] == ["a"]
