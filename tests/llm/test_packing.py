import random

from pyspark.sql import functions as F

from lectern.llm import packing


def brute(sizes, sources, clusters, capacity):
    bins, out = [], []
    for s, a, c in zip(sizes, sources, clusters, strict=True):
        best = None
        for i, (used, sa, sc) in enumerate(bins):
            if capacity - used >= s and a not in sa and c not in sc and (best is None or used > bins[best][0]):
                best = i
        if best is None:
            bins.append((0, set(), set()))
            best = len(bins) - 1
        used, sa, sc = bins[best]
        bins[best] = (used + s, sa | ({a} - {None}), sc | ({c} - {None}))
        out.append(best)
    return out


def test_against_brute_force():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(0, 70)
        args = (sorted((r.randint(0, 30) for _ in range(n)), reverse=True), [r.choice([None, 0, 0, 0, 1, 2, 3]) for _ in range(n)], [r.choice([None, 1, 2, 3, 4, 5]) for _ in range(n)], 40)
        assert packing.best_fit(*args)[0] == brute(*args)


def check_bins(pieces, sizes, sources, capacity):
    """Rows (id, piece, start, size, bin, place): documents are whole, places follow each other, and no bin is too full or has a source twice."""
    total, bins = {}, {}
    for p in pieces:
        total[p[0]] = total.get(p[0], 0) + p[3]
        bins.setdefault(p[4], []).append(p)
    assert total == sizes
    for held in bins.values():
        at = 0
        for p in sorted(held, key=lambda p: (p[5], p[3])):
            assert p[5] == at and p[2] == p[1] * capacity
            at += p[3]
        assert at <= capacity
        known = [sources[p[0]] for p in held if sources[p[0]]]
        assert len(known) == len(set(known))


def test_frames(spark):
    rows = [(i, " ".join(["w"] * (i % 40)), f"s{i % 5 if i % 3 else 0}") for i in range(300)] + [(300, None, None), (301, "", "s1"), (302, " ".join(map(str, range(2500))), "s2"), (303, "same text", None), (304, "same text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin", F.lit("clash"))
    s = packing.Settings(capacity=64, shard_items=100)
    got = packing.pack_texts(df, s=s).collect()
    texts = {r[0]: (r[1] or "", r[2]) for r in rows}
    check_bins([(r.doc_id, r.piece, r.start, r["size"], r.bin, r.place) for r in got], {i: len(t.split()) for i, (t, _) in texts.items()}, {i: c for i, (_, c) in texts.items()}, 64)
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(texts[r.doc_id][0])
    for held in bins.values():
        same = [t for t in held if t]
        assert len(same) == len(set(same))
    assert packing.pack_texts(df.limit(0), s=s).count() == 0


def test_equal_rows_and_rows_without_an_id_are_spread(spark):
    same = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    none = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("source"))
    got = packing.pack_texts(same.unionByName(none).repartition(5), s=packing.Settings(capacity=64, shard_items=100)).collect()
    assert len(got) == 7000
    shards, bins = {}, {}
    for r in got:
        shards[r.bin // packing.SHARD_BINS] = shards.get(r.bin // packing.SHARD_BINS, 0) + 1
        bins.setdefault(r.bin, []).append(r)
    assert len(shards) > 60 and max(shards.values()) < 250
    for held in bins.values():
        assert sum(r.doc_id == 7 for r in held) <= 1  # copies and one source never share a bin
        assert sum(r["size"] for r in held) <= 64
