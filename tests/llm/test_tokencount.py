import pyarrow.parquet as pq
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import queries, tokencount

from ..conftest import SF

BLOB = open(P.path("piece_bpe_32k.model"), "rb").read()
MODEL = sentencepiece.SentencePieceProcessor(model_proto=BLOB)
PROOF = tokencount.prove(BLOB)


def test_proof():
    assert PROOF.apart and {" the", "ing", "\n", " ", "    "} <= PROOF.whole
    for p in sorted(PROOF.whole)[::97]:
        assert len(MODEL.encode("\n" + p)) == len(MODEL.encode("\n")) + 1


def test_unproven_model_takes_whole_texts(monkeypatch):
    monkeypatch.setattr(tokencount, "plain", lambda _: False)
    proof = tokencount.prove(BLOB)
    texts = ["a b\nc", None, "", "  x "]
    assert not proof.apart and not proof.whole
    assert tokencount.Tokens(MODEL, proof, 10).of(texts) == [(len(MODEL.encode(t or "")), 0) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("aething .,10 \n\t▁<s>/é漢\U0001f600\0　'-_="), max_size=60), max_size=4))
def test_as_the_library(texts):
    assert [n for n, _ in tokencount.Tokens(MODEL, PROOF, 20).of(texts)] == [len(MODEL.encode(t)) for t in texts]


def test_operator(spark):
    texts = ["", None, " ", "x" * 300_000, "<s> </s> <unk> <0x0A> ▁", "  lead\n\n  and  trail  ", "the " * 5000, "é\U0001f600", "the the the", "the the the"]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "id": F.lit(1), "n_bytes": F.lit(2)})
    rows = {r.doc_id or 0: r for r in tokencount.count_tokens(df, BLOB, room=50).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = len(MODEL.encode(t or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), want, want > 4096)
        assert rows[i].n_whole <= want
    assert tokencount.count_tokens(df.limit(0), BLOB).count() == 0


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        n = len(MODEL.encode(d["text"] or ""))
        assert (got[d["doc_id"]].n_tokens, got[d["doc_id"]].n_bytes, got[d["doc_id"]].over_limit) == (n, len((d["text"] or "").encode()), n > 4096)
