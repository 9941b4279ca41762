"""Ingestion: sources, their state, and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import source_key, utc_now
from .models import Model

STATE = "key string, status string, chunks long, error string, updated_at string"


def latest_state(log: DataFrame) -> DataFrame:
    """The last entry of each source."""
    return log.groupBy("key").agg(F.max_by(F.struct("status", "chunks", "error", "updated_at"), "updated_at").alias("s")).select("key", "s.*")


def pending(sources: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Sources that are not done; all of them with ``force``."""
    keyed = sources.withColumn("key", source_key(F.col("source_type"), F.col("path")))
    return keyed if force else keyed.join(state.where("status = 'done'").select("key"), "key", "left_anti")


def counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


def marked(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("key", "status", F.col("chunks").cast("long").alias("chunks"), F.coalesce("error", F.lit("")).alias("error"), utc_now().alias("updated_at"))


def flat_metadata(df: DataFrame, *columns: str) -> DataFrame:
    """Scalars as they are, structs, arrays and maps as JSON text."""
    return df.withColumns({c: F.to_json(c) for c in columns if df.schema[c].dataType.typeName() in ("struct", "array", "map")})


def indexed(chunks: DataFrame, embedder: Model, text: str = "page_content") -> DataFrame:
    return chunks.withColumn("embedding", embedder.column(F.col(text), fail=True))


#: Bits of a chunk's number in its source, and of a source's number in its run.
CHUNK_BITS, SOURCE_BITS = 20, 28


def positioned(chunks: DataFrame, sources: DataFrame, index: DataFrame | None, keep: bool = False) -> DataFrame:
    """Adds ``position``, which orders chunks by run, then by their source's kind and path, then by ``chunk_idx``.

    The run follows the last one of the index; with ``keep`` a source that the index has keeps its place, so that
    ingesting it again gives the same positions. A row of ``sources`` is a file's name.
    """
    last = index.agg(F.max("position")).first()[0] if index is not None else None
    run = 0 if last is None else (last >> (CHUNK_BITS + SOURCE_BITS)) + 1
    new = F.shiftleft((F.row_number().over(Window.orderBy("type_order", "path")) - 1).cast("long"), CHUNK_BITS) + F.lit(run << (CHUNK_BITS + SOURCE_BITS))
    numbers = sources.select(F.col("path").alias("source"), new.alias("_n"))
    if keep and index is not None:
        held = index.groupBy("source").agg(F.min("position").alias("_p"))
        numbers = numbers.join(held, "source", "left").select("source", F.coalesce(F.shiftleft(F.shiftright("_p", CHUNK_BITS), CHUNK_BITS), "_n").alias("_n"))
    fits = F.when(F.col("chunk_idx") >= 1 << CHUNK_BITS, F.raise_error(F.concat(F.lit("too many chunks in "), "source")).cast("long")).otherwise(F.col("chunk_idx").cast("long"))
    return chunks.join(numbers, "source").withColumn("position", F.col("_n") + fits).drop("_n", "chunk_idx")


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether there is any file below the path, by the file system that the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(where) and fs.listFiles(where, True).hasNext())


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
