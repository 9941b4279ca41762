import corpus_pipeline as P
from pyspark.sql import functions as F

from lectern.llm import common, packing, repetition, weak_quality

from .test_minhash import classes
from .test_packing import check_bins
from .test_substring import without_repeats


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(50, 60), (60, 50), (55, 60), (70, 70)], "a long, b long")
    got = {r.node: r.root for r in common.components(links).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40) if i % 10)
    assert got[60] == 50 and got[55] == 50 and 70 not in got


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    want, before = docs.columns, docs
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "quality_rules", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for _, stage in P.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf))
        assert docs.columns == want and 0 < docs.count() <= before.count()
        before = docs
    packed = P.STAGES[-1][1](spark, docs, sf)
    sizes = {r.doc_id: r["s"] for r in packed.groupBy("doc_id").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()}
    assert sizes == {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    whole = {tuple(r) for r in P.run(spark, sf).collect()}
    assert whole == {tuple(r) for r in packed.collect()}


def test_run_against_brute_force(spark):
    """Verdicts of the two filters are the operators' own, which tests of their own hold; all else is plain Python over the rows."""
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    good = {r.doc_id for r in weak_quality.classify(docs).collect() if r.kept}
    fine = {r.doc_id for r in repetition.quality_rules(docs).collect() if r.kept}
    rows = [r for r in docs.orderBy("doc_id").collect() if r.doc_id in good and r.doc_id in fine]
    root = classes([r.text for r in rows])
    left = [r for i, r in enumerate(rows) if root[i] == i]
    words = {r.doc_id: w for r, w in zip(left, without_repeats([r.text for r in left], 51), strict=True) if w or not r.text}
    packed = P.run(spark, sf).collect()
    sizes = {}
    for r in packed:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r["size"]
    assert sizes == {i: len(w) for i, w in words.items()}
    check_bins([(r.doc_id, r.piece, r.start, r["size"], r.bin, r.place) for r in packed], {i: len(w) for i, w in words.items()}, {r.doc_id: r.source for r in left}, packing.Settings().capacity)


def test_rows_of_all_kinds(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    text = docs.where("length(text) BETWEEN 500 AND 2000").first().text
    odd = [(None, None, None, None, None), (70_001, "", "en", "s", 0), (70_002, text + " alone " * 3, None, None, None), (70_002, text + " alone " * 3, None, None, None), (70_002, "some other words under the same id, that are not a copy of anything else here", "en", "s", 1), (None, text, "en", "s", 1), (70_004, " ".join(f"w{i}" for i in range(120_000)), "en", "s", 1)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in ("id", "k", "t", "row", "root", "bands", "score", "kept", "starts", "n", "part", "size"):
        rows = rows.withColumn(name, F.lit(name))
    names = rows.columns
    for _, stage in P.STAGES[:-1]:
        rows = common.stored(stage(spark, rows, ""))
        assert rows.columns == names
    assert rows.where("doc_id = 70002").groupBy("text").count().where("count > 1").count() == 0
    assert P.STAGES[-1][1](spark, rows, "").select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()


def test_equal_rows_keep_their_text(spark):
    text = " ".join(f"word{i * 7 % 1000}" for i in range(200))
    docs = spark.createDataFrame([(5, text, "en", "s", len(text))] * 3 + [(8, text + " more", "en", "s", 1)], common.table(spark, "/root/testdata/sf0.001", "documents").schema)
    once = common.stored(P.near_dedup(spark, docs, ""))
    assert [(r.doc_id, r.text) for r in once.collect()] == [(5, text)]
    assert [(r.doc_id, r.text) for r in P.suffix_dedup(spark, once, "").collect()] == [(5, text)]


def test_empty_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
