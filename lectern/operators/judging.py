"""Judged metrics: a model gives verdicts on an answer, and their shares are the scores.

The judge is an injected model from a prompt to JSON ``{"verdicts": [{"verdict":
"yes" or "no", "reason": …}, …]}``, one verdict for each item in order. A prompt ends
in a JSON object of what is judged, so it needs no parsing of prose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .evaluation import METRICS, THRESHOLD
from .models import Model

#: What the judge gets back to.
SCHEMA = {"type": "object", "properties": {"verdicts": {"type": "array", "items": {"type": "object", "properties": {"verdict": {"type": "string", "enum": ["yes", "no"]}, "reason": {"type": "string"}}, "required": ["verdict"]}}}, "required": ["verdicts"]}
FORM = "Answer with a JSON object whose list verdicts has, for each item in order, an object of verdict (yes or no) and reason."
TASKS = (
    "For each item, a statement of an answer, say yes if it bears on the question it is held against, else no.",
    "For each item, a statement of an answer, say no if the passages it is held against contradict it or do not bear it out, else yes.",
    "For each item, a retrieved passage, say yes if it helps to reach the expected answer to the question it is held against, else no.",
)


def sentences(text: Column) -> Column:
    """The statements of an answer: its sentences."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def verdicts(cases: DataFrame, judge: Model, fail: bool = False) -> DataFrame:
    """(row_id, name, verdicts) of test cases for each metric: null where the judge gave none."""
    against = (F.col("input"), F.array_join("retrieval_context", "\n"), F.concat_ws("\n", "input", "expected_output"))
    items = (sentences(F.col("actual_output")), sentences(F.col("actual_output")), F.filter("retrieval_context", lambda x: ~is_blank(x)))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.concat(F.lit(f"{task}\n{FORM}\n"), F.to_json(F.struct(a.alias("against"), i.alias("items")))).alias("prompt")) for name, task, a, i in zip(METRICS, TASKS, against, items, strict=True)])
    rows = cases.select("row_id", F.inline(asked))
    parsed = F.from_json(judge.column(F.col("prompt"), fail=fail), "verdicts array<struct<verdict:string,reason:string>>")
    return rows.select("row_id", "name", parsed["verdicts"].alias("verdicts"))


def judged(cases: DataFrame, judge: Model, threshold: float = THRESHOLD, fail: bool = False) -> DataFrame:
    """(row_id, name, score, threshold, success, reason): the share of verdicts that hold, or for passages the mean over the good ones of the share of good ones up to each."""
    good = F.transform("verdicts", lambda v: F.when(F.lower(strip(v["verdict"])) != "no", 1.0).otherwise(0.0))
    rows = verdicts(cases, judge, fail).withColumn("good", good)
    n, hits = F.size("good"), F.aggregate("good", F.lit(0.0), lambda a, x: a + x)
    share = F.when(n > 0, hits / n)
    up_to = F.transform("good", lambda x, i: F.when(x > 0, F.aggregate(F.slice("good", 1, i + 1), F.lit(0.0), lambda a, y: a + y) / (i + 1)).otherwise(0.0))
    ranked = F.when(n > 0, F.coalesce(F.try_divide(F.aggregate(up_to, F.lit(0.0), lambda a, x: a + x), hits), F.lit(0.0)))
    score = F.when(F.col("name") == METRICS[2], ranked).otherwise(share)
    reason = F.when(F.col("verdicts").isNull(), "no verdict").otherwise(F.array_join(F.filter(F.transform("verdicts", lambda v: v["reason"]), lambda x: x != ""), " "))
    return rows.select("row_id", "name", score.alias("score"), F.lit(threshold).alias("threshold"), F.coalesce(score >= threshold, F.lit(False)).alias("success"), reason.alias("reason"))
