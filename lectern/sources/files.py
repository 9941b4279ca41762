"""Reading: source files, evaluation sets, chat logs, layout blocks and the index."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..operators.blocks import BLOCK_SCHEMA
from ..operators.ingest import STATE, has_data

TURN = "ts_utc string, user string, assistant string, metadata map<string,string>"
DATASET = "question string, ground_truth string, contexts array<string>, answer string"


def _is_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else; the engine's own parser stops after the first."""

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        def fine(text: str) -> bool:
            try:
                json.loads(text)
            except ValueError:
                return False
            return True

        return texts.map(fine)

    return check(c)


def list_sources(spark: SparkSession, pdf_dir: str | None, text_dir: str | None) -> DataFrame:
    """(source_type, path, type_order): PDF files, then markdown and plain text, each by path; order by the last two."""
    parts = []
    for order, (kind, where, rule) in enumerate((("pdf", pdf_dir, r"(?s).*\.pdf"), ("markdown", text_dir, r"(?is).*\.(md|txt)"))):
        if where and has_data(spark, where):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where).select("path")
            parts.append(files.where(F.col("path").rlike(rule)).select(F.lit(kind).alias("source_type"), "path", F.lit(order).alias("type_order")))
    if not parts:
        return spark.createDataFrame([], "source_type string, path string, type_order int")
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def read_texts(spark: SparkSession, where: str) -> DataFrame:
    """(source, text): each markdown or text file whole."""
    rows = spark.read.option("recursiveFileLookup", True).text(where, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return rows.where(F.col("source").rlike(r"(?i)\.(md|txt)$"))


def parse_files(spark: SparkSession, where: str, parser: Callable[..., list[dict]], pages: tuple[int, int | None] = (0, None), only: DataFrame | None = None) -> DataFrame:
    """Layout blocks of every PDF, or of those in ``only`` (path), by an injected parser of (path, content), one file a task slice; failures are rows with ``error``.

    A parser with a third parameter is given the pages and need not read others.
    """
    sliced = len(inspect.signature(parser).parameters) > 2
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(where).select("path", "content")
    files = files if only is None else files.join(only, "path", "left_semi")
    first, last = pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    found = [b for b in (parser(path, content, pages) if sliced else parser(path, content)) if first <= (b.get("page_idx") or 0) and (last is None or (b.get("page_idx") or 0) <= last)]
                    out.append((path, json.dumps(found, ensure_ascii=False), None))
                except Exception as e:  # one file must not end the others
                    out.append((path, "[]", f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["source", "blocks", "error"])

    return files.mapInArrow(run, "source string, blocks string, error string")


def blocks_of(parsed: DataFrame) -> DataFrame:
    """Block rows of parsed files; the document is numbered by a hash of its path."""
    fields = ", ".join(f for f in BLOCK_SCHEMA.split(", ") if not f.startswith(("doc_id", "block_idx")))
    rows = parsed.select("source", F.xxhash64("source").alias("doc_id"), F.posexplode(F.from_json("blocks", f"array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ') for x in fields.split(', ')))}>>")).alias("block_idx", "b"))
    return rows.select("source", "doc_id", "block_idx", "b.*")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows from a JSON object, an array or JSON lines, in file order as ``line``; a byte-order mark is skipped.

    Non-object rows are left out; a line that is no JSON, a blank question or ground
    truth, and an empty file are errors.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    head = (whole.select(F.left(F.ltrim("v"), F.lit(1)).alias("c")).first() or [""])[0]
    if head == "[" or (head == "{" and whole.select(_is_json(F.col("v"))).first()[0]):
        items = F.when(F.ltrim("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
        rows = whole.select(F.posexplode(items).alias("line", "v"))
    else:
        rows = whole.select(F.posexplode(F.split("v", "\r?\n")).alias("line", "v")).where(~is_blank("v"))
        rows = rows.withColumn("v", F.when(~_is_json(F.col("v")), F.raise_error(F.concat(F.lit("no JSON in line "), F.col("line") + 1))).otherwise(F.col("v")))
    parsed = rows.where(F.ltrim("v").startswith("{")).select((F.col("line") + 1).cast("long").alias("line"), F.from_json("v", DATASET).alias("r")).select("line", "r.*")
    bad = [r.line for r in parsed.where(is_blank("question") | is_blank("ground_truth")).orderBy("line").limit(20).collect()]
    if bad:
        raise ValueError(f"question and ground_truth must not be blank; rows {bad}")
    if parsed.isEmpty():
        raise ValueError("the dataset has no rows")
    return parsed


def read_turns(spark: SparkSession, history_dir: str, session: str) -> DataFrame:
    """(seq, user, assistant) of a session; lines that are no JSON objects and turns with two blank sides are skipped."""
    where = f"{history_dir}/session_id={session}"
    if not has_data(spark, where):
        return spark.createDataFrame([], "ts_utc string, user string, assistant string")
    rows = spark.read.text(where).select(F.from_json("value", TURN).alias("t")).select("t.ts_utc", strip(F.coalesce("t.user", F.lit(""))).alias("user"), strip(F.coalesce("t.assistant", F.lit(""))).alias("assistant"))
    return rows.where("user <> '' OR assistant <> ''")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The ingest log; none yet is an empty one."""
    return spark.read.schema(STATE).json(path) if has_data(spark, path) else spark.createDataFrame([], STATE)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of an index, wherever they lie in its folders; none if there is no index."""
    return spark.read.parquet(path).drop("bucket") if has_data(spark, path) else None


def sparse_documents(index: DataFrame) -> DataFrame:
    """Trimmed non-empty contents of the index with their metadata; no vectors are read."""
    rest = [c for c in index.columns if c not in ("page_content", "embedding")]
    return index.select(strip("page_content").alias("page_content"), *rest).where("page_content <> ''")
