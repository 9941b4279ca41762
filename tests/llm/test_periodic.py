import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import periodic, queries


def brute(words):
    """(start, length, period) by the definition, and the words that stay."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    runs = sorted(((a, length, q) for (a, length), q in found.items()), key=lambda r: (r[0], r[2]))
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made(seed):
    r = random.Random(seed)
    kind = r.randrange(4)
    n = r.randrange(0, 90)
    if kind == 0:
        return [r.choice("ab") for _ in range(n)]
    if kind == 1:
        p = r.randrange(1, 20)
        some = [r.choice("abcdef") for _ in range(p)]
        return [r.choice("xyz") for _ in range(r.randrange(9))] + [some[i % p] for i in range(n)] + ["z"] * r.randrange(15)
    if kind == 2:
        a, b = ["a"], ["a", "b"]
        while len(b) < 70:
            a, b = b, b + a
        return b[:n]
    return [str(r.randrange(200)) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 50, 1 << 19])
def test_runs_as_defined(block):
    texts = [made(i) for i in range(300)]
    ids = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    word = np.array([ids[w] for t in texts for w in t])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = [[] for _ in texts]
    for a, b, q in periodic.runs(doc, word, periodic.Settings(block=block)).tolist():
        got[doc[a]].append((a - first[doc[a]], b - a, q))
    assert [sorted(g, key=lambda r: (r[0], r[2])) for g in got] == [brute(t)[0] for t in texts]


def test_operator(spark):
    texts = ["", None, "  \t ", "a" * 100_000, "a " * 30_000, "é x y\n" * 20, *(" ".join(made(i)) for i in range(40)), "b b", "b b"]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"runs": F.lit(1), "id": F.lit(2), "collapsed": F.lit(3)})
    rows = {r.doc_id or 0: r for r in periodic.periodic_runs(df.repartition(3)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        words = split(t)
        runs, kept = brute(words) if len(words) < 1000 else ([(0, len(words), 1)], words[0])
        assert (rows[i].n_words, [tuple(r) for r in rows[i].runs], rows[i].collapsed) == (len(words), runs, kept)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_loops_of_the_query(spark):
    rows = [(i, " \n".join(f"w{j}" for j in range(i % 57))) for i in range(400)] + [(1, None), (None, "x y")]
    got = {r.doc_id: r.text for r in queries.with_loops(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id != 1}
    for i, t in rows:
        if i == 1:
            continue
        w, h = split(t), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        assert split(got[i]) == w
