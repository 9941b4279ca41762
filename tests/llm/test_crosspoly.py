import numpy as np

from lectern.llm import crosspoly


def brute(rows, least):
    ok = {i: np.array(v, float) for i, v, label in rows if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: c for i, _, c in rows}
    near = {i: set() for i, _, _ in rows}
    for i in ok:
        for j in ok:
            if i < j and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= least:
                near[i].add(j)
                near[j].add(i)
    root = {}
    for i in sorted(x for x in near if x is not None):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += near[x]
    return {i: (len(near[i]), root.get(i)) for i in near}


def corpus():
    rng = np.random.default_rng(4)
    f32 = lambda v: np.float32(v).tolist()
    rows = []
    for c in range(12):
        base = rng.normal(size=32)
        for _ in range(8):
            rows.append((len(rows), f32(base + rng.normal(size=32) * rng.choice([0.05, 0.2, 0.3])), c % 3))
    rows += [(len(rows) + k, f32(rng.normal(size=32)), 1) for k in range(60)]
    copy = rows[5][1]
    rows += [(len(rows) + k, copy, rows[5][2]) for k in range(30)] + []
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] * 32, 1), (n + 3, copy, None), (n + 4, [], 1), (n + 5, [None] * 32, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for s in (crosspoly.Settings(), crosspoly.Settings(block=7, hashes=1, tables=14)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in crosspoly.linked(df, s=s).collect()}
        assert got == brute(rows, 0.93)


def test_empty_and_one_row(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3)], "vec_id long, embedding array<float>, label int")
    assert crosspoly.linked(df.limit(0)).count() == 0
    assert [tuple(r) for r in crosspoly.linked(df).collect()] == [(1, 0, 1)]


def test_labels_and_components_as_they_are(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    for kind, labels in (("string", ["x", "x", "y", None]), ("double", [1.2, 1.2, 1.7, None]), ("date", None)):
        if kind == "date":
            import datetime

            labels = [datetime.date(2020, 1, 1), datetime.date(2020, 1, 1), datetime.date(2020, 1, 2), None]
        df = spark.createDataFrame([(i, b if i == 1 else a, c, "clash") for i, c in enumerate(labels)], f"vec_id long, embedding array<float>, label {kind}, component_id string")
        assert {r.vec_id: (r.n_links, r.component_id) for r in crosspoly.linked(df).collect()} == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3)}
    wide = [(0, [1e-60, 0.0], 0.0), (1, [1e60, 0.0], -0.0), (2, [1e-200, 1e-220], 0.0), (3, [0.0, 1e308], 0.0), (4, [-0.0, 1e-308], 0.0)]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>, label double")
    assert {r.vec_id: (r.n_links, r.component_id) for r in crosspoly.linked(df).collect()} == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3)}


def test_equal_rows_and_repeated_ids(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (5, [2.0, 4.0], 1), (None, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in crosspoly.linked(df).collect()) == [(-1, 0, -1), (3, 2, 3), (3, 2, 3), (5, 2, 3)]


def test_more_hashes_for_large_labels():
    s = crosspoly.Settings()
    assert s.suited(60_000, 64) == s
    assert (s.suited(70_000, 64).hashes, s.suited(70_000, 64).tables) == (3, 14)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    y = x + rng.normal(size=x.shape) * 0.27
    cosine = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    at = np.flatnonzero(cosine >= 0.93)
    grown = s.suited(10**7, 64)
    assert grown.hashes > 2 and len(at) > 300
    (a, pa_), (b, pb) = (crosspoly.buckets(v[at], np.zeros(len(at), np.int64), grown) for v in (x, y))
    met = ((a[:, :, None] == pb).any(2) | (b[:, :, None] == pa_).any(2)).any(1)
    assert met.mean() > 0.97
