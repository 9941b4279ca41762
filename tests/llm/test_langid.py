import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lectern.llm import langid, queries

from ..conftest import SF
from . import plain


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    found = langid.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = found.join(docs, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) == 1000 and len(held) > 200
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    sure = [r for r in held if not r.rejected]
    assert sum(r.lang_pred == r.lang for r in sure) / len(sure) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000, None, "en"), (10_001, "12 34 !!", "en"), (10_002, "", None), (None, "of the and to", None)], docs.schema)
    rows = {r.doc_id: r for r in langid.identify(docs.unionByName(odd).withColumn("score", F.lit("x")), F.lit(True)).collect()}
    assert [rows[i].lang_pred for i in (10_000, 10_001, 10_002)] == ["und"] * 3
    assert rows[10_000].score == 0 and rows[None].lang_pred == "en"
    # very long texts, repeated rows, and a text of two languages
    german = next(r.text for r in docs.where("lang = 'de'").orderBy(F.length("text").desc()).limit(1).collect())
    more = spark.createDataFrame([(20_000, german * 100, None), (20_001, german, "fr"), (20_001, german, "fr"), (20_002, "the of and der die und " * 20, None), (20_003, "x" * 300_000, None)], docs.schema)
    found = langid.identify(docs.unionByName(more), F.lit(True)).where("doc_id >= 20000").collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 5 and by_id[20_000].lang_pred == "de" and len({(r.lang_pred, r.score) for r in found if r.doc_id == 20_001}) == 1
    assert by_id[20_002].lang_pred in ("en", "de") and all(0 <= r.score <= 1 for r in found)
    alone = langid.identify(docs.limit(5), F.lit(False)).collect()
    assert {r.lang_pred for r in alone} == {"und"}
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_null_id_is_not_held_out(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(60).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op2_language_id(spark, str(tmp_path)).collect()
    assert len(rows) == 61 and all(isinstance(r.held_out, bool) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]


ODD = ["", "a", "12 !", "Don't stop", "Straße über\u00a0alles", "日本語 text", "x\n\ny", "é" * 50]


def expected(model, text):
    """Language and score of a text, n-gram by n-gram."""
    text = pc.utf8_lower(pa.scalar(text or "")).as_py()
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    found = plain.buckets(text, model.settings.orders, model.settings.bits, str.isalpha)
    hidden = sum(model.embeddings[b].astype(float) for b in found) / len(found)
    x = hidden @ model.softmax.astype(float) / model.temperature
    p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    return model.langs[int(p.argmax())], float(p.max())


def test_every_row_against_a_plain_predictor(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    usable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = langid.fit(langid.sample(docs, usable, "doc_id", "text", "lang", langid.Settings()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op2_language_id(spark, SF).collect()
    assert len(rows) == len(texts) and len(model.langs) > 1
    for r in rows:
        lang, score = expected(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, r
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    lang, score, _ = model.predict(pa.array([*ODD, None]))
    for text, a, b in zip([*ODD, None], lang, score, strict=True):
        assert a == expected(model, text)[0] and abs(b - expected(model, text)[1]) < 1e-4, text


def test_a_text_is_judged_alike_beside_any_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = langid.fit(langid.sample(docs, F.lit(True), "doc_id", "text", "lang", langid.Settings(epochs=2)))
    texts = [*ODD, "of the", "der die das"]
    alone = [model.predict(pa.array([t])) for t in texts]
    together = model.predict(pa.array(texts))
    assert [a[0][0] for a in alone] == together[0]
    assert np.allclose([a[1][0] for a in alone], together[1], atol=1e-9)
