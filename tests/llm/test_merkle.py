import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    for nodes in levels[:-1]:
        a = i // 16 * 16
        yield nodes[a:i], nodes[i + 1 : a + 16]
        i //= 16


def brute(rows):
    """rows: (id, group, leaf, claimed)."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([r[2] for r in groups[g]]) for g in names}
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (ident, _, own, claimed) in enumerate(groups[g]):
            proof, folded = "", claimed
            for left, right in [*path(trees[g], i), *path(top, k)]:
                proof += "".join(left + right)
                folded = h(*left, folded, *right)
            out.append((ident, own, trees[g][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows_of(groups):
    out = []
    for g, n in groups:
        for i in range(n):
            ident = None if i == 5 else i - i % 2 if i < 20 else i
            own = leaf(ident, g, i % 7 if i >= 20 else 1)
            out.append((ident, g, own, h(own) if i % 5 == 0 and i >= 20 else own))
    return out


@pytest.mark.parametrize("levels,few,groups", [
    (3, 50_000, [(None, 3), ("", 1), ("hot", 4999), ("é", 17), ("z", 16), ("a", 256), ("b", 257)]),
    (1, 0, [("hot", 4200), *((f"s{i}", 1 + i % 3) for i in range(40)), (None, 20)]),
    (2, 50_000, [("only", 1)]),
    (2, 50_000, [("only", 300)]),
])
def test_as_defined(spark, monkeypatch, levels, few, groups):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "FEW", few)
    rows = rows_of(groups)
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string, claimed string").withColumns({"pos": F.lit(1), "g": F.lit(2), "block": F.lit(3)}).repartition(5)
    got = merkle.manifest(df, "source", "doc_id", "leaf", "claimed")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, source string, leaf string, claimed string")
    assert merkle.manifest(df, "source", "doc_id", "leaf", "claimed").count() == 0


def test_leaf(spark):
    values = [(1, None, "é", "x" * 200_000), (None, "", "a:b", None)]
    got = spark.createDataFrame(values, "a long, b string, c string, d string").select(merkle.leaf(*map(F.col, "abcd")).alias("h")).collect()
    assert [r.h for r in got] == [leaf(*v) for v in values]
