import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import repetition

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    longest = 0
    for n in range(5, len(words)):
        if max(Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)).values()) < 2:
            break
        longest = n
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), longest]


texts = st.lists(st.one_of(st.none(), st.text(alphabet="abé \n\t #|", max_size=200)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_figures(column):
    found = repetition.measure(pa.array(column, pa.string()))
    for i, t in enumerate(column):
        assert [int(v[i]) for k, v in found.items() if k not in ("kept", "base_failed")] == brute(t)


def test_longest_repeat_decides():
    words = [f"w{i}" for i in range(600)]
    copied = words + words[:60]
    rules = repetition.Rules()
    found = repetition.measure(pa.array([" ".join(words), " ".join(copied), " ".join(words[:60] * 2)]), rules)
    assert found["kept"].tolist() == [True, True, False]  # 60 of 660 words are below a tenth of the text
    strict = repetition.measure(pa.array([" ".join(copied)]), repetition.Rules(max_longest_share=5))
    assert strict["kept"].tolist() == [False] and strict["base_failed"].tolist() == [False]


def test_suffix_array_of_each_text():
    rng = np.random.default_rng(0)
    for _ in range(50):
        doc = np.sort(rng.integers(0, 3, 40))
        word = rng.integers(0, 3, 40).astype(np.uint64)
        ids = np.unique(word, return_inverse=True)[1]
        ends = np.searchsorted(doc, doc, "right")
        assert repetition.suffix_array(doc, word).tolist() == sorted(range(40), key=lambda i: (doc[i], ids[i : ends[i]].tolist()))


def test_frames(spark):
    rows = [(1, "a b c d e f g h i j k", "x"), (1, "a b c d e f g h i j k", "x"), (None, None, None), (4, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = repetition.quality_rules(df).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.kept) for r in out) == [(-1, 0, False), (1, 11, True), (1, 11, True), (4, 0, False)]
    assert repetition.quality_rules(df.limit(0)).count() == 0
    kept = repetition.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 2


def morse(n):
    """Two different strings of two letters to which polynomials modulo 2**64 give one hash."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_regular_words_are_told_apart():
    x, y = morse(1024)
    assert x != y and len(x) == 1024
    lines = f"{x}\n{y}"
    five = f"x1 x2 x3 x4 {x} x1 x2 x3 x4 {y}"
    of_words = [" ".join(t) for t in morse(1024)]
    found = repetition.measure(pa.array([lines, five, f"{x}\n{x}", *of_words]))
    assert found["n_dup_lines"].tolist() == [0, 0, 1, 0, 0]
    assert found["n_repeat_words"].tolist()[:3] == [0, 0, 0]
    assert not found["base_failed"][1]


def test_very_long_text():
    words = [f"w{i % 70_000}" for i in range(200_000)]
    found = repetition.measure(pa.array([" ".join(words)]))
    assert (found["n_words"][0], found["n_repeat_words"][0], found["longest_repeat"][0]) == (200_000, 200_000, 130_000)
