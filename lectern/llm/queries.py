"""The registered queries of the training-data operators: whole tables in, whole results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crosspoly, hpylm, html_crf, langid, merkle, minhash, oracles, packing, periodic, repetition, substring, tokencount, weak_quality
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    held = docs.select("doc_id", "text", "lang")
    found = langid.identify(held, F.coalesce(rest != 2, F.lit(True)))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.decode(encoded, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.main_text(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crosspoly.linked(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return tokencount.count_tokens(table(spark, sf_dir, "documents"), f.read())


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by their id, the words from one place on repeat a few that stand there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    sized = words.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    looped = F.expr("concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int((n - a) div p + 1))), 1, int(n - a)))")
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_loops(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("most"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("most.col2"), F.col("most.length"), -F.col("most.col3")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    as_is = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select("doc_id", "source", as_is(F.col("text")).alias("leaf"), F.when(tampered, as_is(F.translate("text", merkle.UPPER, merkle.LOWER))).alias("claimed"))
    return merkle.manifest(rows.withColumn("claimed", F.coalesce("claimed", "leaf")), "source", "doc_id", "leaf", "claimed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
