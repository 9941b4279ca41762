"""Corpus statistics that are kept for each ingest run and merged, not counted again.

A run's row holds exact sums (documents, tokens), a HyperLogLog sketch of its distinct tokens and a KLL sketch of its
document lengths in tokens, a few kilobytes however many texts it read. Rows of runs merge into the statistics of any set
of them. With 2**12 registers the standard error of a distinct count is 1.6 %; a quantile's rank is off by
about 1 % with ``k`` = 200.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import tokens

REGISTERS, K = 12, 200
QUANTILES = (0.5, 0.9, 0.99)


def of_runs(docs: DataFrame, run: str, text_col: str = "text") -> DataFrame:
    """(run, n_docs, n_tokens, distinct, lengths): one row a run, from one scan; tasks send one row of sketches a run.

    An empty or null text is a document of length 0.
    """
    all_tokens = tokens(text_col)
    # a row for each token, and one for the text; nothing else is carried through the explode
    row = lambda token, n: F.struct(token.cast("string").alias("token"), n.cast("long").alias("len"))
    parts = F.array_append(F.transform(all_tokens, lambda t: row(t, F.lit(None))), row(F.lit(None), F.size(all_tokens)))
    rows = docs.select(F.col(run).alias("run"), F.inline(parts))
    return rows.groupBy("run").agg(
        F.count("len").alias("n_docs"),
        F.coalesce(F.sum("len"), F.lit(0)).alias("n_tokens"),
        F.hll_sketch_agg("token", F.lit(REGISTERS)).alias("distinct"),
        F.kll_sketch_agg_bigint("len", F.lit(K)).alias("lengths"),
    )


def add(docs: DataFrame, path: str, run: str, text_col: str = "text") -> None:
    """Writes the rows of the runs of ``docs`` (column ``run``); those that are there already are replaced, so a repeated run counts once."""
    rows = of_runs(docs, run, text_col)
    rows.repartition("run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(runs: DataFrame, *by: str) -> DataFrame:
    """The runs' rows as one, or as one for each value of ``by``."""
    return runs.groupBy(*by).agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_bigint("lengths").alias("lengths"),
    )


def estimates(rows: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(n_docs, n_tokens, avg_len, distinct_tokens, p50, …): exact sums, an estimated distinct count and length quantiles; without documents lengths are null."""
    names = [f"p{q * 100:g}" for q in quantiles]
    some = F.col("n_docs") > 0
    lengths = [F.when(some, F.kll_sketch_get_quantile_bigint("lengths", F.lit(q))).alias(n) for n, q in zip(names, quantiles, strict=True)]
    rest = [c for c in rows.columns if c not in ("n_docs", "n_tokens", "distinct", "lengths")]
    average = F.when(some, F.col("n_tokens") / F.col("n_docs")).alias("avg_len")
    return rows.select(*rest, "n_docs", "n_tokens", average, F.hll_sketch_estimate("distinct").alias("distinct_tokens"), *lengths)
