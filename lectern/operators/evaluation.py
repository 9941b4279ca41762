"""Evaluation: cases, verdict ratios, results and summaries."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Names and threshold of the metrics (fixed values).
METRICS = ("Answer Relevancy", "Faithfulness", "Contextual Precision")
THRESHOLD = 0.01


class PreconditionError(RuntimeError):
    """Nothing can be evaluated."""


def numbered(rows: DataFrame, order: str, question: str = "question", limit: int | None = None) -> DataFrame:
    """``row_id`` from 1 in order of a number, given before rows with a blank question are left out.

    Rows are numbered within ranges of the number, which quantiles bound, and from the
    sizes of the ranges before; a null comes first.
    """
    marks = rows.agg(F.percentile_approx(order, [i / 200 for i in range(1, 200)])).first()[0] or []
    within = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(marks)))), lambda m: m < F.col(order))), F.lit(0)) if marks else F.lit(0)
    ranged = rows.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(within))
    sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())  # 201 rows at most
    before = F.create_map(*[F.lit(x) for (r, _), n in zip(sizes, accumulate((n for _, n in sizes), initial=0), strict=False) for x in (r, n)]) if sizes else F.create_map(F.lit(0), F.lit(0))
    out = ranged.withColumn("row_id", (F.element_at(before, F.col("_range")) + F.row_number().over(Window.partitionBy("_range").orderBy(order))).cast("long")).drop("_range")
    if limit is not None:
        out = out.where(F.col("row_id") <= max(1, limit))
    return out.where(~is_blank(question))


def test_cases(records: DataFrame) -> DataFrame:
    return records.select("row_id", F.col("question").alias("input"), F.col("answer").alias("actual_output"), F.col("ground_truth").alias("expected_output"), F.col("contexts").alias("retrieval_context"))


def validated_dataset(rows: DataFrame) -> DataFrame:
    """The rows; an error on the first blank question or ground truth when read."""
    bad = is_blank("question") | is_blank("ground_truth")
    return rows.where(F.when(bad, F.raise_error(F.lit("question and ground_truth must not be blank")).cast("boolean")).otherwise(True))


def share_of(good: Column) -> Column:
    """Part of the verdicts that hold; null without verdicts."""
    return F.try_divide(F.sum(good.cast("double")), F.count("*"))


def contextual_precision(verdicts: DataFrame, case: str, rank: str, relevant: str) -> DataFrame:
    """Mean over the relevant places of the share of relevant ones up to each; 0 without any."""
    w = Window.partitionBy(case).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col(relevant).cast("int")
    rows = verdicts.withColumn("_p", F.sum(hit).over(w) / F.count("*").over(w))
    return rows.groupBy(case).agg(F.coalesce(F.try_divide(F.sum(F.when(hit == 1, F.col("_p"))), F.sum(hit)), F.lit(0.0)).alias("score"))


def padded(cases: DataFrame, results: DataFrame, key: str = "row_id", message: str = "no result") -> DataFrame:
    """A result of every metric for every case: those without any get three failures; results of no case are left out."""
    failures = F.array(*[F.struct(F.lit(m).alias("name"), F.lit(None).cast("double").alias("score"), F.lit(THRESHOLD).alias("threshold"), F.lit(False).alias("success"), F.lit(message).alias("reason")) for m in METRICS])
    grouped = results.groupBy(key).agg(F.collect_list(F.struct("name", F.col("score").cast("double").alias("score"), F.col("threshold").cast("double").alias("threshold"), "success", "reason")).alias("found"))
    return cases.join(grouped, key, "left").select(key, F.inline(F.coalesce("found", failures)))


def summary(results: DataFrame, key: str = "row_id") -> DataFrame:
    """(name, mean_score, pass_rate, count, threshold): the mean of numeric scores, passes over all results, the first threshold."""
    return results.groupBy("name").agg(
        F.bround(F.avg(F.col("score").cast("double")), 4).alias("mean_score"),
        F.bround(F.try_divide(F.sum(F.coalesce(F.col("success"), F.lit(False)).cast("double")), F.count("*")), 4).alias("pass_rate"),
        F.count("*").alias("count"),
        F.min_by(F.col("threshold").cast("double"), key).alias("threshold"),
    )


def rollup(results: DataFrame, sets: list[list[str]], key: str = "row_id") -> DataFrame:
    """The summary for each of several sets of columns at once; columns that a row's set has not are null, and ``grouping`` tells them from null values: a bit for each column, the first one the highest."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    by = [[F.col(c) for c in s] for s in sets]
    return results.groupingSets(by, *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("grouping"),
        F.bround(F.avg(F.col("score").cast("double")), 4).alias("mean_score"),
        F.bround(F.try_divide(F.sum(F.coalesce(F.col("success"), F.lit(False)).cast("double")), F.count("*")), 4).alias("pass_rate"),
        F.count("*").alias("count"),
    )


def detailed(records: DataFrame, results: DataFrame, key: str = "row_id") -> DataFrame:
    """One row a record with its metrics and the number of its contexts."""
    metrics = results.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("name", "score", "threshold", "success", "reason"))).alias("metrics"))
    return records.join(metrics, key, "left").withColumn("contexts_count", F.greatest(F.size("contexts"), F.lit(0)))
