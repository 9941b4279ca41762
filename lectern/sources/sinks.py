"""Writing: the index, the chat log, the ingest log and evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import session_id, utc_now
from ..operators.ingest import has_data, marked, remove


#: Folders of an index that is written by source.
BUCKETS = 256


def bucket_of(source: str) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int")


def write_index(chunks: DataFrame, path: str, force: bool = False, batch: int = 256) -> None:
    """Appends rows; ``force`` replaces all. The same source twice is there twice; ``upsert_index`` writes by source. A file holds 4,000 batches at most."""
    dealt = chunks.withColumn("bucket", bucket_of("source"))
    dealt.write.mode("overwrite" if force else "append").option("maxRecordsPerFile", 4000 * max(1, batch)).partitionBy("bucket").parquet(path)


def upsert_index(chunks: DataFrame, sources: DataFrame, path: str, batch: int = 256) -> None:
    """Writes the rows of ``sources`` (source); rows that the index has of them are replaced, so writing twice leaves one copy.

    The index lies in folders by a hash of the source. The folders of these sources are written anew, with the rows of their
    other sources, and take the old ones' place when the whole write has succeeded; no other folder is read or written.
    A source without rows leaves the index.
    """
    spark = chunks.sparkSession
    touched = {r[0] for r in sources.select(bucket_of("source")).distinct().collect()}  # BUCKETS at most
    if not touched:
        return
    rows = chunks.withColumn("bucket", bucket_of("source"))
    if has_data(spark, path):
        old = spark.read.parquet(path).where(F.col("bucket").isin(sorted(touched)))
        rows = rows.unionByName(old.join(sources.select("source").distinct(), "source", "left_anti"), allowMissingColumns=True)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    seen = Observation()
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("source", "position"), F.lit(parts))).observe(seen, F.collect_set("bucket").alias("buckets"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 4000 * max(1, batch)).partitionBy("bucket").parquet(path)
    for bucket in touched - set(seen.get["buckets"]):
        remove(spark, f"{path}/bucket={bucket}")


def write_parsed(parsed: DataFrame, path: str) -> None:
    """The parser's blocks as JSON lines, beside the index: a line for each source, or for each block where files were read by pages."""
    rows = ("source", "blocks") if "blocks" in parsed.columns else ("source", "page_idx", "pos", "block")
    parsed.where("error IS NULL").select(*rows).write.mode("overwrite").json(path)


def clear_index(spark: SparkSession, path: str) -> None:
    if has_data(spark, path):
        remove(spark, path)


def append_turns(turns: DataFrame, history_dir: str) -> None:
    """JSON lines by session; turns have session, user, assistant and perhaps metadata."""
    extra = ["metadata"] if "metadata" in turns.columns else []
    rows = turns.select(session_id("session").alias("session_id"), utc_now().alias("ts_utc"), F.trim("user").alias("user"), F.trim("assistant").alias("assistant"), *extra)
    rows.write.mode("append").partitionBy("session_id").json(history_dir)


def clear_session(spark: SparkSession, history_dir: str, session: str) -> None:
    remove(spark, f"{history_dir}/session_id={session}")


def append_state(outcomes: DataFrame, path: str) -> None:
    marked(outcomes).write.mode("append").json(path)


def write_evaluation(records: DataFrame, summary: DataFrame, detailed: DataFrame, out_dir: str, prefix: str = "") -> dict[str, str]:
    """Three JSON outputs: the inputs, the summary, the details."""
    name = prefix.strip() or "evaluation"
    paths = {k: f"{out_dir}/{name}_{k}" for k in ("live_inputs", "summary", "detailed")}
    for frame, path in zip((records, summary, detailed), paths.values(), strict=True):
        frame.write.mode("overwrite").json(path)
    return paths
