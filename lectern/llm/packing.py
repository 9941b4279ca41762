"""Conflict-constrained best-fit packing of documents into sequences.

A document longer than the capacity is cut into full pieces and a rest. Pieces are
dealt by a hash of the row and the piece, and of a number among equal rows, into shards of about ``shard_items`` pieces, so no
source, cluster or repeated id gathers in one task, and each shard is packed on its own: pieces
in decreasing size, each into the open bin with the smallest residual that holds
it and has no document of the same source or of the same duplicate cluster. Bins
are kept by residual; a bin's sources and clusters are bitmaps; the search goes on
from residual to residual until the tightest compatible bin is found, and opens a
bin only when there is none.

Null sources and clusters conflict with nothing; null and empty texts are one piece
of no size; equal rows are pieces of their own (of one cluster, so in different
bins), and ids may be null. Without equal rows the result depends on the rows only, not on where they lie. Other columns are
never read.
"""

from __future__ import annotations

from bisect import insort
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Shards get numbers of their own below this many bins.
SHARD_BINS = 1 << 24


@dataclass(frozen=True)
class Settings:
    capacity: int = 1024
    shard_items: int = 2048


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and place within it of each item, taken in the given order."""

    def bits(values: list) -> list[int]:
        """A bit for each value that comes more than once; the rest cannot conflict."""
        seen: dict = {}
        for v in values:
            if v is not None:
                seen[v] = seen.get(v, 0) + 1
        number: dict = {}
        return [0 if v is None or seen[v] < 2 else 1 << number.setdefault(v, len(number)) for v in values]

    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_at = 0  # bit r: some bin has the residual r
    held_sources: list[int] = []
    held_clusters: list[int] = []
    filled: list[int] = []
    bins, places = [], []
    for size, source, cluster in zip(sizes, bits(sources), bits(clusters), strict=True):
        ahead, found = open_at >> size, -1
        residual = size - 1
        while ahead:
            step = (ahead & -ahead).bit_length()
            residual += step
            for b in by_residual[residual]:
                if not held_sources[b] & source and not held_clusters[b] & cluster:
                    found = b
                    break
            if found >= 0:
                break
            ahead >>= step
        if found < 0:
            found = len(filled)
            filled.append(0)
            held_sources.append(0)
            held_clusters.append(0)
        else:
            by_residual[residual].remove(found)
            if not by_residual[residual]:
                open_at ^= 1 << residual
        bins.append(found)
        places.append(filled[found])
        filled[found] += size
        held_sources[found] |= source
        held_clusters[found] |= cluster
        left = capacity - filled[found]
        insort(by_residual[left], found)  # a tie goes to the oldest bin
        open_at |= 1 << left
    return bins, places


def pack(docs: DataFrame, size: str, source: str, cluster: str, id_col: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """(id, piece, start, size, bin, place): where each piece of each document goes; ``docs`` has the id, its size, source and cluster."""
    id_type = docs.schema[id_col].dataType.simpleString()
    need = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), need.alias("need"), F.xxhash64(source).alias("source_h"), F.col(source).isNull().alias("no_source"), F.xxhash64(cluster).alias("cluster_h"), F.col(cluster).isNull().alias("no_cluster"))
    # equal rows are numbered where they lie, so that they go to different shards
    alike = rows.groupBy(*rows.columns, F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    rows = alike.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("salt", F.when(F.col("k") > 0, F.col("part") * F.lit(1 << 32) + F.col("k")).otherwise(0)).drop("part", "n", "k")
    total = rows.agg(F.sum(F.greatest(F.ceil(F.col("need") / s.capacity), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // s.shard_items))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("need") / s.capacity) - 1, F.lit(0).cast("long")))).alias("piece"))
    pieces = pieces.select(
        "id",
        "piece",
        F.least(F.lit(s.capacity).cast("long"), F.col("need") - F.col("piece") * s.capacity).alias("size"),
        F.when(~F.col("no_source"), F.col("source_h")).alias("source"),
        F.when(~F.col("no_cluster"), F.col("cluster_h")).alias("cluster"),
        F.pmod(F.xxhash64("id", "piece", "need", "source_h", "cluster_h", "salt"), F.lit(shards)).alias("shard"),
    )
    capacity = s.capacity

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        bins, places = best_fit(*(table.column(c).to_pylist() for c in ("size", "source", "cluster")), capacity)
        shard = table.column("shard")[0].as_py()
        start = [p * capacity for p in table.column("piece").to_pylist()]
        return pa.table([table.column("id"), table.column("piece"), pa.array(start, pa.int64()), table.column("size"), pa.array([shard * SHARD_BINS + b for b in bins], pa.int64()), pa.array(places, pa.int64())], [id_col, "piece", "start", "size", "bin", "place"])

    return pieces.groupBy("shard").applyInArrow(run, f"`{id_col}` {id_type}, piece long, start long, size long, bin long, place long")


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", s: Settings = Settings()) -> DataFrame:
    """Packs texts by their words; the cluster of a text is its set of exact copies."""
    words = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    # texts are read once: what is packed is their sizes
    sized = common.stored(docs.select(F.col(id_col), words.alias("n_words_"), F.col(source_col).alias("source_"), F.when(F.col(text_col) != "", F.xxhash64(text_col)).alias("cluster_")))
    return pack(sized, "n_words_", "source_", "cluster_", id_col, s)
