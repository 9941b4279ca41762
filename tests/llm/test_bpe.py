import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import bpe, queries

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
WHOLE = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_as_the_library_encodes(spark):
    texts = ["", None, "Hello  world's\n\n  \tx", "é\U0001f600 <|endoftext|> 123 '", " lead", "a" * 5000, "don't  ''s !'s   x", "the the the"] * 2
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit(1))
    encoded = bpe.encode(df, RANKS, P.PATTERN)
    rows = {r.doc_id: r for r in bpe.decode(encoded, RANKS).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i or None].ids == WHOLE.encode_ordinary(t or "")
        assert bytes(rows[i or None].bytes) == (t or "").encode()
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_small_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5, "doc_id")
    rows = bpe.encode(docs, RANKS, P.PATTERN).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == 200 and all(r.ids == WHOLE.encode_ordinary(r.text) for r in rows)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = WHOLE.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
