"""Continuous ingestion: new text files are chunked, embedded and appended as they come.

An extension of the batch job: the stream's own checkpoint takes the place of the
ingest log, so each file is taken once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import recursive_chunks
from ..operators.ingest import CHUNK_BITS, indexed
from ..operators.models import Model
from ..sources.sinks import bucket_of


def text_stream(spark: SparkSession, where: str, per_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).text(where)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")).where(F.col("source").rlike(r"(?i)\.(md|txt)$"))


def start_ingest(spark: SparkSession, where: str, index: str, checkpoint: str, embedder: Model, size: int = 1000, overlap: int = 400, once: bool = True) -> StreamingQuery:
    chunks = recursive_chunks(text_stream(spark, where), size, overlap, id_col="source").withColumnRenamed("text", "page_content")
    # a stream has no list of sources to number: a file's place is a hash of its name, after all batch runs' rows
    # (41 bits: even odds for two of 1.7 million files to share one)
    place = F.shiftright(F.xxhash64("source"), 22).bitwiseAND(F.lit((1 << 41) - 1))
    chunks = chunks.withColumns({"position": F.lit(1 << 62) + F.shiftleft(place, CHUNK_BITS) + F.col("chunk_idx"), "bucket": bucket_of("source")})
    writer = indexed(chunks, embedder).writeStream.partitionBy("bucket").format("parquet").option("path", index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
