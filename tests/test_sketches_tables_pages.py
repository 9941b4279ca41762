"""Merged statistics, table functions and the paged parser."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lectern import engine
from lectern.config import Settings
from lectern.functions import tables
from lectern.operators import chunking, models, retrieval, sketches
from lectern.sources import files, paged

from .conftest import SF


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_merged_sketches_are_near_the_exact_statistics(spark, docs, tmp_path):
    odd = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "one", None)], "doc_id long, text string, source string")
    every = docs.select("doc_id", "text", "source").unionByName(odd)
    for _ in range(2):  # a run that is repeated counts once
        for part in ("doc_id % 2 = 0", "doc_id % 2 <> 0"):
            sketches.add(every.where(part).withColumn("run", F.lit(part)), f"{tmp_path}/s", "run")
    got = sketches.estimates(sketches.merged(sketches.read(spark, f"{tmp_path}/s"))).first()
    exact = retrieval.corpus_stats(every).first()
    distinct = retrieval.document_frequency(every).count()
    assert got.n_docs == exact.n_docs == docs.count() + 3
    assert abs(got.avg_len - exact.avg_len) < 1e-9
    assert abs(got.distinct_tokens - distinct) <= 0.05 * distinct
    lengths = sorted(r[0] for r in every.select(F.size(retrieval.tokens("text"))).collect())
    for q in sketches.QUANTILES:
        value = got[f"p{q * 100:g}"]
        below, upto = sum(n < value for n in lengths), sum(n <= value for n in lengths)
        assert below / len(lengths) - 0.03 <= q <= upto / len(lengths) + 0.03


def test_sketches_by_run_merge_to_the_whole(spark, docs):
    runs = sketches.of_runs(docs, "source")
    whole = sketches.of_runs(docs.withColumn("all", F.lit(1)), "all")
    a, b = sketches.estimates(sketches.merged(runs)).first(), sketches.estimates(whole).first()
    assert (a.n_docs, a.n_tokens) == (b.n_docs, b.n_tokens) and abs(a.distinct_tokens - b.distinct_tokens) <= 0.02 * b.distinct_tokens
    none = sketches.estimates(sketches.merged(sketches.of_runs(docs.limit(0), "source"))).first()
    assert none.n_docs == 0 and none.avg_len is None and none.p50 is None


def test_chunks_by_lateral_join(spark, docs):
    tables.register(spark)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "  "), (-4, "a b. " * 5000)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    got = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk(d.text, 1000, 400) c", docs=every)
    want = chunking.sliding_chunks(every, chunking.ChunkSettings(1000, 400))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL split_text(d.text, size => 300, overlap => 50) c", docs=every)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.recursive_chunks(every, 300, 50).collect()))


@pytest.mark.parametrize("call", ["chunk(1)", "chunk('a', 0)", "chunk('a', length(d.text))", "chunk('a', 'b')", "chunk('a', 10, -1)"])
def test_table_functions_check_their_arguments(spark, docs, call):
    tables.register(spark)
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT c.* FROM {{docs}} d, LATERAL {call} c", docs=docs).schema


def paged_parser(log):
    """Pages are parts between form feeds, and blocks their lines; notes which task read which pages."""

    class Parser:
        def count(self, path, file):
            text = file.read().decode()
            if text.startswith("broken"):
                raise ValueError("no pages")
            return len(text.split("\f"))

        def parse(self, path, file, first, last):
            import os
            from pyspark import TaskContext

            pages = file.read().decode().split("\f")
            with open(os.path.join(log, f"{TaskContext.get().partitionId()}-{first}-{last}-{os.path.basename(path)}"), "w"):
                pass
            if any(p == "torn" for p in pages[first : last + 1]):
                raise ValueError("torn page")
            return [{"type": "text", "text": line, "page_idx": first + i} for i, p in enumerate(pages[first : last + 1]) for line in p.split("\n")]

    return Parser()


def whole_parser(path, content):
    pages = content.decode().split("\f")
    if pages[0].startswith("broken") or "torn" in pages:
        raise ValueError("bad")
    return [{"type": "text", "text": line, "page_idx": i} for i, p in enumerate(pages) for line in p.split("\n")]


@pytest.fixture
def pdfs(docs, tmp_path):
    where, log = tmp_path / "pdf", tmp_path / "log"
    (where / "in ner").mkdir(parents=True)
    log.mkdir()
    texts = [(r.text or "").replace("\f", " ") for r in docs.orderBy("doc_id").limit(60).collect()]
    (where / "large.pdf").write_text("\f".join(texts))
    (where / "in ner" / "small é.pdf").write_text("one\ntwo\fthree")
    (where / "empty.pdf").write_text("")
    (where / "broken.pdf").write_text("broken")
    (where / "torn.pdf").write_text("\f".join([*texts[:20], "torn"]))
    (where / "other.txt").write_text("not read")
    return str(where), log


def same(spark, where, got, pages=(0, None)):
    want = files.blocks_of(files.parse_files(spark, where, whole_parser, pages))
    cols = ("source", "doc_id", "block_idx", "page_idx", "type", "text")
    key = lambda rows: sorted(tuple(r[c] for c in cols) for r in rows.collect())
    assert got.columns == want.columns and key(got) == key(want)


def test_one_file_is_many_tasks_with_the_same_blocks(spark, pdfs):
    where, log = pdfs
    raw = paged.read_pages(spark, where, paged_parser(str(log)), splitBytes=4000, batchPages=3)
    same(spark, where, paged.blocks_of(raw))
    read = [p.name.split("-", 3) for p in log.iterdir()]
    large = [x for x in read if x[3] == "large.pdf"]
    assert len({x[0] for x in large}) > 2 and all(int(x[2]) - int(x[1]) < 3 for x in large)
    assert not any(x[3] == "other.txt" for x in read)
    assert {r.source.rsplit("/", 1)[1] for r in paged.failures(raw).collect()} == {"broken.pdf", "torn.pdf"}


def test_pages_are_cut_before_they_are_parsed(spark, pdfs):
    where, log = pdfs
    for pages in ((1, 2), (50, None), (900, None)):
        log_ = log / f"{pages[0]}"
        log_.mkdir()
        raw = paged.read_pages(spark, where, paged_parser(str(log_)), pages, splitBytes=4000)
        rows = paged.blocks_of(raw).collect()
        assert {r.page_idx for r in rows} == set(range(pages[0], min(60, (pages[1] or 59) + 1)))
        assert all(int(p.name.split("-")[1]) >= pages[0] for p in log_.iterdir())


def test_only_pending_files_are_parsed(spark, pdfs, tmp_path):
    where, log = pdfs
    for name in ("broken.pdf", "torn.pdf"):
        (tmp_path / "pdf" / name).unlink()
    s = Settings(pdf_dir=where, markdown_dir=str(tmp_path / "none"), index_dir=str(tmp_path / "ix"), checkpoint_dir=str(tmp_path / "state"))
    embed = models.stub_embedding(8)
    assert engine.prepare_index(spark, s, embed, paged_parser(str(log)), checkpoint=True, side_dir=str(tmp_path / "side")) == {"processed": 2, "skipped": 0, "failed": 0}
    for p in log.iterdir():
        p.unlink()
    (tmp_path / "pdf" / "new.pdf").write_text("newly come")
    assert engine.prepare_index(spark, s, embed, paged_parser(str(log)), checkpoint=True)["processed"] == 1
    assert {p.name.split("-", 3)[3] for p in log.iterdir()} == {"new.pdf"}
    found = files.read_index(spark, s.index_dir)
    assert found.where(F.col("source").endswith("new.pdf")).first().page_content == "newly come"
    assert set(spark.read.json(str(tmp_path / "side")).columns) == {"source", "page_idx", "pos", "block"}


def test_small_files_share_a_task():
    assert [p.pieces for p in paged.dealt([("a", 3), ("b", 3), ("c", 25), ("d", 5), ("e", 0)], 10)] == [[("c", 0, 3)], [("c", 1, 3)], [("c", 2, 3)], [("a", 0, 1), ("b", 0, 1)], [("d", 0, 1), ("e", 0, 1)]]
    assert paged.dealt([], 10) == []
