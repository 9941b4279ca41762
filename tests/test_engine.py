"""The three jobs end to end, with stub models and files."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import engine
from lectern.config import Settings
from lectern.operators import evaluation, models
from lectern.sources import files
from lectern.streaming import ingest as stream


@pytest.fixture
def setup(tmp_path):
    docs = tmp_path / "md"
    docs.mkdir()
    (docs / "a.md").write_text("alpha beta gamma. " * 40)
    (docs / "b.TXT").write_text("delta epsilon zeta. " * 40)
    (docs / "c.bin").write_text("ignored")
    return Settings(markdown_dir=str(docs), pdf_dir=str(tmp_path / "pdf"), index_dir=str(tmp_path / "index"), checkpoint_dir=str(tmp_path / "state"), history_dir=str(tmp_path / "chat"), eval_dir=str(tmp_path / "eval"), chunk_size=200, chunk_overlap=40)


@pytest.mark.parametrize("folder", ["one", "another/place", "z"])
def test_ties_go_by_the_order_of_ingestion(spark, tmp_path, folder):
    where = tmp_path / folder
    docs = where / "md"
    docs.mkdir(parents=True)
    for name, text in (("a.md", "alpha beta"), ("b.md", "alpha gamma"), ("c.md", "alpha delta")):
        (docs / name).write_text(text)
    s = Settings(markdown_dir=str(docs), index_dir=str(where / "index"), chunk_size=50, chunk_overlap=0)
    embed = models.stub_embedding(8)
    engine.prepare_index(spark, s, embed)
    (docs / "0.md").write_text("alpha late")
    later = Settings(**{**vars(s), "checkpoint_dir": str(where / "state")})
    engine.prepare_index(spark, later, embed)
    rows = files.read_index(spark, s.index_dir).orderBy("position").collect()
    assert [r.source.rsplit("/", 1)[1] for r in rows] == ["a.md", "b.md", "c.md", "0.md", "a.md", "b.md", "c.md"]
    asked = spark.createDataFrame([(0, "nothing of it")], "q long, question string")
    flat = Settings(**{**vars(s), "hybrid_dense_weight": 0.0, "hybrid_sparse_weight": 1.0, "top_k": 3})
    assert engine.answer(spark, flat, asked, embed, models.stub()).first().contexts == ["alpha beta", "alpha gamma", "alpha delta"]


def test_index_query_chat_and_evaluation(spark, setup, tmp_path):
    embed, model = models.stub_embedding(256), models.stub()
    assert engine.prepare_index(spark, setup, embed, checkpoint=True) == {"processed": 2, "skipped": 0, "failed": 0}
    assert engine.prepare_index(spark, setup, embed, checkpoint=True)["skipped"] == 2
    asked = spark.createDataFrame([(0, "alpha beta"), (1, "delta zeta")], "q long, question string")
    got = {r.q: r for r in engine.answer(spark, setup, asked, embed, model).collect()}
    assert "alpha" in got[0].contexts[0] and "delta" in got[1].contexts[0]
    assert got[0].answer.startswith("answer ")
    engine.chat(spark, setup, "s 1", "alpha?", embed, model)
    assert files.read_turns(spark, setup.history_dir, "s_1").count() == 1
    data = tmp_path / "set.jsonl"
    data.write_text("\ufeff" + "\n".join(json.dumps({"question": q, "ground_truth": "t"}) for q in ("alpha?", "delta?")) + "\n\n")

    def judge(cases):
        return cases.where("row_id = 1").select("row_id", F.lit("Faithfulness").alias("name"), F.lit(1.0).alias("score"), F.lit(0.01).alias("threshold"), F.lit(True).alias("success"), F.lit("ok").alias("reason"))

    paths = engine.evaluate(spark, setup, str(data), embed, model, judge)
    names = {r.name: r for r in spark.read.json(paths["summary"]).collect()}
    assert names["Faithfulness"].pass_rate == 0.5 and names["Answer Relevancy"].pass_rate == 0
    with pytest.raises(evaluation.PreconditionError):
        engine.answer(spark, Settings(index_dir=str(tmp_path / "none")), asked, embed, model)


def test_parsed_files_keep_failures_apart(spark, setup, tmp_path):
    pdf = tmp_path / "pdf"
    pdf.mkdir()
    (pdf / "x.pdf").write_bytes(b"x")
    (pdf / "y.pdf").write_bytes(b"bad")

    def parser(path, content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"type": "text", "text": "Title", "text_level": 1, "page_idx": 0}, {"type": "text", "text": "omega words here", "page_idx": 0}, {"type": "table", "table_caption": ["T"], "table_body": "<td>1</td>", "page_idx": 1, "bbox": [0, 0, 1, 1]}]

    with pytest.raises(RuntimeError):
        engine.prepare_index(spark, setup, models.stub_embedding(8), parser, models.stub("about"), force=True)
    rows = files.read_index(spark, setup.index_dir).where(F.col("source").endswith(".pdf")).collect()
    assert any("omega" in r.page_content for r in rows) and any('"special_type":"table"' in (r.metadata or "") for r in rows)
    # whole blocks packed, pages handed to a parser that takes them, and its blocks kept beside the index
    (pdf / "y.pdf").unlink()
    seen = []

    def sliced(path, content, pages):
        seen.append(pages)
        return parser(path, content)

    packed = Settings(**{**vars(setup), "index_dir": str(tmp_path / "packed"), "markdown_dir": str(tmp_path / "none")})
    engine.prepare_index(spark, packed, models.stub_embedding(8), sliced, pages=(0, 0), side_dir=str(tmp_path / "side"), packing=True)
    rows = files.read_index(spark, packed.index_dir).collect()
    assert len(rows) == 1 and "Title" in rows[0].page_content and '"page_start":0' in rows[0].metadata
    assert spark.read.json(str(tmp_path / "side")).count() == 1
    (pdf / "y.pdf").write_bytes(b"bad")
    assert [r.source_type for r in files.list_sources(spark, str(pdf), setup.markdown_dir).orderBy("type_order", "path").collect()] == ["pdf", "pdf", "markdown", "markdown"]


def test_dataset_errors(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('[{"question": " ", "ground_truth": "x"}]')
    with pytest.raises(ValueError):
        files.read_dataset(spark, str(bad))
    one = tmp_path / "one.json"
    one.write_text('{"question": "q", "ground_truth": "x", "contexts": ["c"]}')
    assert files.read_dataset(spark, str(one)).first().contexts == ["c"]


def test_stream(spark, setup, tmp_path):
    where = str(tmp_path / "streamed")
    for _ in range(2):
        stream.start_ingest(spark, setup.markdown_dir, where, str(tmp_path / "cp"), models.stub_embedding(8), 200, 40).awaitTermination(120)
    rows = spark.read.parquet(where)
    assert rows.select("source").distinct().count() == 2
    assert rows.groupBy("source", "chunk_idx").count().where("count > 1").count() == 0
