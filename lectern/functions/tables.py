"""Chunkers as table functions, for lateral joins in SQL.

    register(spark)
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL chunk(text, 1000, 400) c")

Sizes are constants and are checked when the statement is analysed. A null text has no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegralType, LongType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunking import ChunkSettings, cuts, recursive_split


def _checked(text: AnalyzeArgument, **sizes: AnalyzeArgument | None) -> dict[str, int]:
    """The sizes that are given, as numbers."""
    if text.isTable or not isinstance(text.dataType, (StringType, NullType)):
        raise ValueError("the first argument must be a text")
    given = {name: a for name, a in sizes.items() if a is not None}
    for name, a in given.items():
        if not isinstance(a.dataType, IntegralType) or not a.isConstantExpression or a.value is None:
            raise ValueError(f"{name} must be a constant whole number")
    return {name: a.value for name, a in given.items()}


class Chunk:
    """``chunk(text, size, overlap, window)``: (chunk_idx, start, end, text) of the sliding window with soft boundaries."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, window: AnalyzeArgument | None = None) -> AnalyzeResult:
        ChunkSettings(**_checked(text, size=size, overlap=overlap, window=window))
        return AnalyzeResult(StructType().add("chunk_idx", LongType()).add("start", LongType()).add("end", LongType()).add("text", StringType()))

    def eval(self, text: str | None, size: int = ChunkSettings.size, overlap: int = ChunkSettings.overlap, window: int = ChunkSettings.window) -> Iterator[tuple]:
        for k, (a, b) in enumerate(cuts(text or "", [], ChunkSettings(size, overlap, window))):
            yield k, a, b, text[a:b]


class SplitText:
    """``split_text(text, size, overlap)``: (chunk_idx, text) of the recursive splitter."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        ChunkSettings(**_checked(text, size=size, overlap=overlap))
        return AnalyzeResult(StructType().add("chunk_idx", LongType()).add("text", StringType()))

    def eval(self, text: str | None, size: int = ChunkSettings.size, overlap: int = ChunkSettings.overlap) -> Iterator[tuple]:
        yield from enumerate(recursive_split(text or "", size, overlap))


def register(spark: SparkSession) -> None:
    """Makes ``chunk`` and ``split_text`` known to the session's SQL."""
    for name, handler in (("chunk", Chunk), ("split_text", SplitText)):
        spark.udtf.register(name, udtf(handler, useArrow=True))
