"""A stored coarse quantiser: vectors in the lists of their nearest centroids, and searches that read some lists.

``build`` fits the centroids by spherical k-means on at most ``sample`` vectors, those with the smallest
hashes of their ids, and then writes every vector to the list of its nearest centroid,
in folders by the list's number. Beside them goes one row for each list: its centroid, how many vectors it has
and the cosine of the one that is furthest from the centroid. That table has at most ``lists`` rows, whatever the number of
vectors, and alone is sent to all tasks.

``search`` compares a question with the vectors of its ``probes`` nearest lists, all in double
precision, and keeps the best k. Unless given, ``probes`` is what ``build`` has measured on its sample: so many
lists hold 95 of 100 of the 20 nearest of 200 sampled vectors. Questions go to the lists as rows, in blocks, so any number of them is
answered by one reading of the lists. With ``exact`` it goes on: a vector of a list is at least as far from the
question as the angle to the centroid less the list's radius, so only lists that may still hold
one of the best k are read, and the results are those of ``retrieval.dense_topk``.

Vectors that are null, zero or hold null or non-finite components are in no list, and such questions have no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import _matrix, _usable
from .scratch import kept

#: Vectors that the centroids are fitted on at most, centroids at most, rounds of k-means, folders, questions that meet a list in one group.
SAMPLE, LISTS, ROUNDS, FOLDERS, BLOCK = 20_000, 4096, 12, 32, 512
#: Vectors of a list that meet its questions in one group, about.
PART = 50_000
#: Cosines are rounded to 6 digits; a bound may be this much below the least one that counts.
SLACK = 2e-6


def centroids(x: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by k-means on cosines; a list that becomes empty takes the vector that is furthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(near.max(1))[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def lists_needed(x: np.ndarray, c: np.ndarray, share: float = 0.95, k: int = 20, asked: int = 200) -> int:
    """How many of its nearest lists a vector has to be compared with to find that share of its k nearest in the sample."""
    q = x[: asked]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    own = (x @ c.T).argmax(1)
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], 1), share)) + 1


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE, mode: str = "overwrite") -> None:
    """Writes the lists; their number is, if not given, four times the square root of the vectors' number, ``LISTS`` at most."""
    spark = vectors.sparkSession
    rows = vectors.where(_usable(vector_col)).select(F.col(id_col).alias("d"), F.col(vector_col).cast("array<double>").alias("v"))
    some = rows.orderBy(F.xxhash64("d"), "d").limit(sample).select("v").toArrow()
    n = lists or min(LISTS, max(1, round(4 * rows.count() ** 0.5)))
    x = _matrix(some.column("v").combine_chunks(), some.num_rows) if some.num_rows else np.zeros((0, 0))
    c = centroids(x, n) if len(x) else x
    probes = lists_needed(x, c) if len(x) else 0
    spread = spark.sparkContext.broadcast(c)
    kind = vectors.schema[id_col].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column("v"), batch.num_rows) @ spread.value.T
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.argmax(1).astype(np.int32)), pa.array(near.max(1))], ["d", "v", "list", "near"])

    dealt = rows.mapInArrow(assign, f"d {kind}, v array<double>, list int, near double").withColumn("folder", F.col("list") % FOLDERS)
    dealt.repartition("folder", "list").sortWithinPartitions("folder", "list").write.mode(mode).partitionBy("folder").parquet(f"{path}/lists")
    sizes = _lists(spark, path, kind).groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("radius"))
    named = spark.createDataFrame([(i, v.tolist(), probes) for i, v in enumerate(c)], "list int, centroid array<double>, probes int")
    named.join(sizes, "list").write.mode(mode).parquet(f"{path}/centroids")


def _lists(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    return spark.read.schema(f"d {id_type}, v array<double>, list int, near double, folder int").parquet(f"{path}/lists")


def _probed(table: pa.Table, questions: DataFrame) -> DataFrame:
    """(q, v, list, place, bound): all lists of each question, by the cosine of the centroid, and the largest cosine that one of its vectors may have."""
    spread = questions.sparkSession.sparkContext.broadcast(table)
    q_type = questions.schema["q"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = spread.value
        c = np.array(held.column("centroid").to_pylist())
        names, radius = held.column("list").to_numpy(), np.arccos(np.clip(held.column("radius").to_numpy(), -1, 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                near = _matrix(part.column("v"), part.num_rows) @ c.T
                order = np.argsort(-near, axis=1, kind="stable")
                angle = np.arccos(np.clip(np.take_along_axis(near, order, 1), -1, 1)) - radius[order]
                n = len(c)
                yield pa.RecordBatch.from_arrays([part.column("q").take(pa.array(np.repeat(np.arange(part.num_rows), n))), pa.array(names[order.ravel()]), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), part.num_rows)), pa.array(np.cos(np.maximum(angle, 0)).ravel())], ["q", "list", "place", "bound"])

    return questions.mapInArrow(run, f"q {q_type}, list int, place int, bound double")


def _compared(lists: DataFrame, pairs: DataFrame, asked: DataFrame, parts: DataFrame, k: int, blocks: int) -> DataFrame:
    """(q, d, score): the best k of each pair (q, list) in each part of a long list; all that tie with the last stay. parts: (list, parts), a row for each list."""
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = pairs.select("q", "list").join(asked, "q").join(F.broadcast(parts), "list").select(F.col("list").alias("list"), block.alias("block"), F.col("q").alias("q"), "v", part.alias("part"))
    wanted = pairs.select("list", block.alias("block")).distinct().join(F.broadcast(parts), "list")
    held = lists.join(wanted, "list").select(F.col("list").alias("list"), F.col("block").alias("block"), "d", "v", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int").alias("part"))
    kind, q_kind = lists.schema["d"].dataType.simpleString(), pairs.schema["q"].dataType.simpleString()

    def run(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        names, types = ["q", "d", "score"], (questions.schema.field("q").type, vectors.schema.field("d").type, pa.float64())
        if not vectors.num_rows or not questions.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        x, q = (_matrix(t.column("v").combine_chunks(), t.num_rows) for t in (vectors, questions))
        out = []
        for begin in range(0, len(x), 4096):
            scores = np.round(q @ x[begin : begin + 4096].T, 6)
            n = scores.shape[1]
            least = np.partition(scores, n - k, axis=1)[:, n - k, None] if k < n else -2.0
            i, j = np.nonzero(scores >= least)
            out.append((i, j + begin, scores[i, j]))
        i, j, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([questions.column("q").take(pa.array(i)), vectors.column("d").take(pa.array(j)), pa.array(score)], names)

    keys = ["list", "block", "part"]
    return held.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(run, f"q {q_kind}, d {kind}, score double")


def search(spark: SparkSession, path: str, questions: DataFrame, k: int, probes: int | None = None, exact: bool = False, id_col: str = "vec_id", id_type: str = "bigint", block: int = BLOCK) -> DataFrame:
    """(q, id, score, rank) by cosine, rounded to 6 digits; ``questions`` has (q, v)."""
    lists = _lists(spark, path, id_type)
    table = spark.read.parquet(f"{path}/centroids").toArrow()  # LISTS rows at most
    asked = questions.where(_usable("v")).select("q", F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    if not table.num_rows:
        return asked.limit(0).select("q", F.lit(None).cast(lists.schema["d"].dataType).alias(id_col), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    probes = table.column("probes")[0].as_py() if probes is None else probes
    parts = spark.createDataFrame([(i, max(1, -(-n // PART))) for i, n in zip(table.column("list").to_pylist(), table.column("n").to_pylist(), strict=True)], "list int, parts int")
    reach = _probed(table, asked)
    near = reach.where(F.col("place") <= probes)
    hits = _compared(lists, near, asked, parts, k, blocks)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    if exact:
        hits = kept(hits)
        least = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("q", F.col("score").alias("least"))
        more = reach.where(F.col("place") > probes).join(least, "q", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
        hits = hits.unionByName(_compared(lists, more, asked, parts, k, blocks))
    return hits.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).withColumnRenamed("d", id_col)
