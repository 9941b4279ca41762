"""Stored indexes against the searches that read everything."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.operators import cells, postings, ranges, retrieval
from lectern.plans import queries

from .conftest import SF


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


HIT = ("item_id", "doc_id", "score", "rank")


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")


def test_postings_give_the_same_documents(spark, tables, tmp_path):
    docs, asked = tables
    odd = spark.createDataFrame([(1000, "the the of zebra"), (1001, "nothing known here qqq"), (1002, ""), (1003, None)], "item_id long, text string")
    asked = asked.select("item_id", "text").unionByName(odd)
    # in two runs, and in blocks of few questions
    postings.add(docs.where("doc_id % 3 <> 0").repartition(3), f"{tmp_path}/ix", run=0)
    postings.add(docs.where("doc_id % 3 = 0"), f"{tmp_path}/ix", run=1)
    index = postings.read(spark, f"{tmp_path}/ix")
    want = rows(retrieval.bm25_topk(docs, asked, 8), *HIT)
    assert rows(postings.topk(index, asked, 8, block=4), *HIT) == want
    stats, whole = postings.corpus_stats(index).first(), retrieval.corpus_stats(docs).first()
    assert stats.n_docs == whole.n_docs and abs(stats.avg_len - whole.avg_len) < 1e-9
    assert rows(postings.document_frequency(index), "token", "df") == rows(retrieval.document_frequency(docs), "token", "df")


def test_cells_that_cannot_count_are_skipped(spark, tmp_path):
    # a word of its own for every thousand documents, said more or less often
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("all "), F.repeat(F.concat(F.lit("w"), (F.col("id") / 1000).cast("int").cast("string"), F.lit(" ")), (1 + F.col("id") % 5).cast("int"))).alias("text")).coalesce(1)
    asked = spark.createDataFrame([(1, "w3 all"), (2, "w5 w5")], "item_id long, text string")
    postings.add(docs, f"{tmp_path}/ix")
    index = postings.read(spark, f"{tmp_path}/ix")
    assert rows(postings.topk(index, asked, 5), *HIT) == rows(retrieval.bm25_topk(docs, asked, 5), *HIT)
    weights, average = postings.weighted(index, asked, postings.Weights(), "item_id", "text")
    bounds = postings.bounds(index, weights, average, postings.Weights())
    least = {q: min(s for i, _, s, _ in rows(postings.topk(index, asked, 5), *HIT) if i == q) for q in (1, 2)}
    cells_of = index.select("run", "cell").distinct().count()
    for q in (1, 2):
        assert bounds.where((F.col("q") == q) & (F.col("bound") >= least[q])).count() <= cells_of / 5


def test_the_index_is_not_shuffled_to_few_tokens(spark, tables, tmp_path, monkeypatch, no_auto_broadcast):
    docs, asked = tables
    postings.add(docs, f"{tmp_path}/ix")
    index, w = postings.read(spark, f"{tmp_path}/ix"), postings.Weights()
    weights, average = postings.weighted(index, asked, w, "item_id", "text")
    want = rows(retrieval.bm25_topk(docs, asked, 3), *HIT)
    for size in (16 << 20, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
        found = postings.bounds(index, weights, average, w)
        hits = postings.scored(index, found, weights, average, 3, w, 1, postings.measured(weights), 9)
        for df in (found, hits):
            plan = df._jdf.queryExecution().executedPlan().toString()
            # the index meets the tokens asked where it is read
            assert ("BroadcastHashJoin" in plan) == (size > 0)
        assert hits.select("q").distinct().count() > 0
        assert rows(postings.topk(index, asked, 3), *HIT) == want


def test_no_question_reads_a_text(spark, tables, tmp_path):
    docs, asked = tables
    postings.add(docs, f"{tmp_path}/ix")
    many = asked.select(F.explode(F.sequence(F.lit(0), F.lit(49))).alias("copy"), (F.col("item_id") * 50 + F.col("copy")).alias("item_id"), "text")
    found = postings.topk(postings.read(spark, f"{tmp_path}/ix"), many.drop("copy"), 3, block=20)
    plan = found._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan
    assert found.count() == 3 * many.count()


def test_postings_where_most_documents_have_the_token(spark, tmp_path):
    # few documents, so that idf is below 0 and a hit counts less than none
    texts = ["a a a", "a", "a b", "", None, "a a", "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (4, "a c c")], "item_id long, text string")
    postings.add(docs, f"{tmp_path}/ix")
    for k in (1, 3, 10):
        assert rows(postings.topk(postings.read(spark, f"{tmp_path}/ix"), asked, k), *HIT) == rows(retrieval.bm25_topk(docs, asked, k), *HIT)
    assert postings.topk(postings.read(spark, f"{tmp_path}/none"), asked, 3).count() == 0


def test_one_scan_for_any_number_of_questions(spark, tables, monkeypatch, no_auto_broadcast):
    docs, asked = tables
    want = set(rows(retrieval.bm25_topk(docs, asked, 3), *HIT))
    many = asked.select(F.explode(F.sequence(F.lit(0), F.lit(49))).alias("copy"), (F.col("item_id") * 50 + F.col("copy")).alias("item_id"), "text").drop("copy")
    for size in (16 << 20, 0):  # blocks are broadcast, and shuffled
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
        found = retrieval.bm25_topk(docs, many, 3, block=20)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and plan.count("FileScan") == 1
        assert ("BroadcastHashJoin" in plan) == (size > 0) and "Cartesian" not in plan and "NestedLoop" not in plan
        got = rows(found, *HIT)
        assert len(got) == 3 * many.count()
        assert {(q // 50, *r) for q, *r in got} == want


def test_slices_hold_every_count(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SLICE_BYTES", 40)  # long texts are slices of their own
    texts = ["a b a", "", None, "b " * 100, "c\u00a0d e", " \t\n", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made = retrieval.sliced(docs).collect()
    assert len(made) > 1
    got = {}
    for r in made:
        at = 0
        for token, df in zip(r.tokens, r.df, strict=True):
            for doc, count in zip(r.doc[at : at + df], r["count"][at : at + df], strict=True):
                got[r.docs[doc], token] = count
            at += df
        for doc, length in zip(r.docs, r.lengths, strict=True):
            assert length == len([t for t in re.split(r"[ \t\n]+", texts[doc] or "") if t])
    assert got == {(i, t): n for i, x in enumerate(texts) for t, n in Counter(t for t in re.split(r"[ \t\n]+", x or "") if t).items()}


def test_slices_are_held_a_few_at_a_time(spark, tables, monkeypatch, tmp_path):
    docs, asked = tables
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(1 << 30))
    monkeypatch.setattr(retrieval, "SLICE_BYTES", 2000)
    monkeypatch.setattr(retrieval, "new_folder", lambda _: f"{tmp_path}/slices")
    assert retrieval.bm25_topk(docs.coalesce(1), asked, 3).count() == 3 * asked.count()
    made = [pq.ParquetFile(p).metadata for p in tmp_path.glob("slices/*.parquet")]
    assert sum(m.num_rows for m in made) > 100
    assert max(m.row_group(i).num_rows for m in made for i in range(m.num_row_groups)) <= retrieval.GROUP
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 8 << 20


def test_a_row_group_holds_one_slice_of_long_texts(spark, monkeypatch, tmp_path):
    """Spark's reader holds a whole row group, whose size is a slice's whatever the table's."""
    texts = [" ".join(f"w{d}x{i}" for i in range(5000)) for d in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "w7x3 w9x1")], "item_id long, text string")
    monkeypatch.setattr(retrieval, "new_folder", lambda _: f"{tmp_path}/slices")
    assert sorted(r.doc_id for r in retrieval.bm25_topk(docs, asked, 2).collect()) == [7, 9]
    made = [pq.ParquetFile(p).metadata for p in tmp_path.glob("slices/*.parquet")]
    groups = [m.row_group(i) for m in made for i in range(m.num_row_groups)]
    assert len(groups) > 2 and max(g.total_byte_size for g in groups) < 3 * retrieval.SLICE_BYTES


def test_a_slice_of_long_texts_is_less_than_a_megabyte(spark):
    docs = spark.createDataFrame([(d, " ".join(f"w{d}x{i}" for i in range(5000))) for d in range(60)], "doc_id long, text string").coalesce(1)
    size = F.aggregate("tokens", F.lit(0), lambda n, t: n + F.octet_length(t) + 8) + 4 * (F.size("df") + F.size("doc") + F.size("count"))
    found = retrieval.sliced(docs).select(size.alias("bytes"), F.size("docs").alias("n")).collect()
    assert sum(r.n for r in found) == 60 and max(r.bytes for r in found) < 1 << 20


def test_a_task_hands_up_the_best_of_its_slices_only(spark, monkeypatch):
    """Equal texts in many slices, larger ids first: the smaller ids win, whatever goes up when."""
    docs = spark.createDataFrame([(i, ["a b", "b", "c a a", ""][i % 4]) for i in range(200, 0, -1)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "a"), (2, "b c"), (3, "nowhere")], "item_id long, text string")
    ranked, scored = retrieval._ranked, []
    monkeypatch.setattr(retrieval, "_ranked", lambda rows, k: scored.append(rows) or ranked(rows, k))
    want = rows(retrieval.bm25_topk(docs, asked, 5), *HIT)
    monkeypatch.setattr(retrieval, "SLICE_BYTES", 8)
    assert rows(retrieval.bm25_topk(docs, asked, 5), *HIT) == want
    assert scored[-1].count() == 5 * 3 * scored[-1].rdd.getNumPartitions()
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
    monkeypatch.setattr(retrieval, "BLOCK_CELLS", 1)  # nothing is held beyond a batch's row
    assert rows(retrieval.bm25_topk(docs, asked, 5), *HIT) == want


def joins(df):
    """How hits meet their documents: the joins by doc_id in a plan."""
    return re.findall(r"(\w+Join) \[doc_id#", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name, at", [("prompt_assembly", 2), ("prepare_contexts", 1), ("rrf_dense_only", 1), ("rrf_fusion", 1), ("rrf_zero_weights", 1)])
def test_whole_texts_of_few_hits_are_not_shuffled(spark, monkeypatch, no_auto_broadcast, name, at):
    few = getattr(queries, name)(spark, SF)
    assert joins(few) == ["BroadcastHashJoin"] * at
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    many = getattr(queries, name)(spark, SF)
    assert joins(many) == ["SortMergeJoin"] * at
    assert rows(few, *few.columns) == rows(many, *few.columns)


def test_bm25_of_odd_questions(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "y z z"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(None, "z"), (1, None), (2, "nowhere"), (3, "z z"), (3, "z")], "item_id long, text string")
    found = retrieval.bm25_topk(docs, asked, 2)
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in found.collect()}
    assert len(got) == 8  # two for each of four questions; the rows of question 3 are one
    assert got[None, 1][0] == 2 and abs(3 * got[None, 1][1] - got[3, 1][1]) < 3e-6
    assert got[1, 1] == got[2, 1] == (1, 0.0)
    assert retrieval.bm25_topk(docs.limit(0), asked, 2).count() == 0
    assert retrieval.bm25_topk(docs, asked.limit(0), 2).count() == 0


def test_many_questions_of_vectors(spark, monkeypatch, no_auto_broadcast):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = vectors.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    want = rows(retrieval.dense_topk(vectors, asked, 5), *NEAR)
    for size in (16 << 20, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
        found = retrieval.dense_topk(vectors, asked, 5, block=4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 2  # the vectors, and the questions, which here are vectors
        assert rows(found, *NEAR) == want


NEAR = ("q", "vec_id", "score", "rank")


def test_lists_find_the_nearest(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    cells.build(vectors, f"{tmp_path}/ann")
    want = rows(retrieval.dense_topk(vectors, asked, 20), *NEAR)
    exact = rows(cells.search(spark, f"{tmp_path}/ann", asked, 20, probes=2, exact=True, block=7), *NEAR)
    assert exact == want
    some = rows(cells.search(spark, f"{tmp_path}/ann", asked, 20), *NEAR)
    pairs = {(q, d) for q, d, _, _ in want}
    recall = len({(q, d) for q, d, _, _ in some} & pairs) / len(pairs)
    assert recall >= 0.9, recall


def test_lists_of_clustered_vectors_read_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART", 30)  # long lists are several groups
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[np.arange(4000) % 40] + 0.15 * rng.normal(size=(4000, 16))
    made = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [0.0] * 15)]
    vectors = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 50 = 0 OR vec_id >= 5000").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    cells.build(vectors, f"{tmp_path}/ann", lists=40, sample=500)
    want = rows(retrieval.dense_topk(vectors, asked, 20), *NEAR)
    assert rows(cells.search(spark, f"{tmp_path}/ann", asked, 20, probes=1, exact=True), *NEAR) == want
    some = {(q, d) for q, d, _, _ in rows(cells.search(spark, f"{tmp_path}/ann", asked, 20, probes=2), *NEAR)}
    assert len(some & {(q, d) for q, d, _, _ in want}) >= 0.9 * len(want)
    cells.build(vectors.limit(0), f"{tmp_path}/none")
    assert cells.search(spark, f"{tmp_path}/none", asked, 5).count() == 0


def test_overlaps(spark):
    rng = np.random.default_rng(5)
    left = [(int(k), int(a), int(a + n)) for k, a, n in zip(rng.integers(0, 3, 200), rng.integers(-50, 400, 200), rng.integers(0, 90, 200), strict=True)] + [(0, None, 5), (None, 1, 9)]
    right = [(int(k), int(a), int(a + n)) for k, a, n in zip(rng.integers(0, 3, 200), rng.integers(-50, 400, 200), rng.integers(0, 30, 200), strict=True)] + [(0, 3, None), (None, 1, 9)]
    x, y = spark.createDataFrame(left, "k long, a long, b long"), spark.createDataFrame(right, "k long, c long, d long")
    want = sorted((k, a, b, c, d) for k, a, b in left for m, c, d in right if None not in (k, a, b, c, d) and k == m and d > a and c < b)
    for width in (1, 16, 8192):
        assert rows(ranges.overlaps(x, y, ["k"], ("a", "b"), ("c", "d"), width), "k", "a", "b", "c", "d") == want


def test_one_document_of_a_million_segments(spark):
    segments = spark.range(1_000_000).select(F.lit(1).alias("doc"), (F.col("id") * 10).alias("c"), (F.col("id") * 10 + 9).alias("d"))
    chunks = spark.range(10_000).select(F.lit(1).alias("doc"), (F.col("id") * 1000).alias("a"), (F.col("id") * 1000 + 1400).alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = ranges.overlaps(chunks, segments, ["doc"], ("a", "b"), ("c", "d"))
        per_task = met.groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) > 1
        assert sum(r["count"] for r in per_task) == 9_999 * 140 + 100
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_as_of(spark):
    rng = np.random.default_rng(9)
    left = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 100), rng.integers(0, 50, 100), strict=True))] + [(1, None, 100), (None, 7, 101), (9, 5, 102)]
    right = [(int(k), int(t), f"s{t}-{i}") for i, (k, t) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 50, 60), strict=True))] + [(1, None, "never"), (None, 5, "null key")]
    x, y = spark.createDataFrame(left, "k long, t long, i long"), spark.createDataFrame(right, "k long, u long, state string")
    got = rows(ranges.as_of(x, y, ["k"], "t", "u", ["u", "state"]), "i", "u", "state")
    want = []
    for k, t, i in left:
        before = [(u, s) for m, u, s in right if m == k and u is not None and t is not None and u <= t]
        want.append((i, *(max(before) if before else (None, None))))
    assert got == sorted(want)
