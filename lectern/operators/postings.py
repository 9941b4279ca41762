"""A stored inverted index, and BM25 over it that skips what cannot be among the best.

Documents are taken in cells of ``CELL`` as they are read. A row of the index is one token in
one cell: the documents, how often each has the token, their lengths, and the block maxima: the largest
count and the smallest length. The rows lie in folders by a hash of the token, in its order, so a search
reads the files and row groups of the tokens that are asked. In the row of the null token a cell has all its
documents. Rows are only ever added, so an index grows run by run, and its statistics are sums over rows.

A search reads no text, whatever the number of questions. The block maxima bound
what a cell can give a question, for any k1, b and mean length. The cells with the largest bounds are
scored first; the k-th best score so far is the least that counts, and only cells whose bound
reaches it are scored too. A cell's postings meet its questions in one group, in blocks of
questions; each group keeps its best k, so what is shuffled grows with postings and results, never with
documents times questions. The tokens asked and the cells that are open go to the index where their measured size
allows it, so that only the rows that are asked for are shuffled; larger sets join by token and by cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded_batches
from .ingest import has_data
from .retrieval import idf_weights, small, tokens
from .scratch import kept

#: Documents of a cell; folders by token; questions that meet a cell in one group; cells of a question that are scored first.
CELL, FOLDERS, BLOCK, LEAD = 128, 32, 256, 2
#: Scores are rounded to 6 digits; a bound may be this much below the least score that counts.
SLACK = 2e-6


@dataclass(frozen=True)
class Weights:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def postings_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, cell, n, most, least, docs, counts, lengths): the rows of an index. Ids are not null; a null text is an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(text_col, F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("part"))

    def cell_rows(docs: pa.Array, texts: pa.Array, cell: int) -> pa.RecordBatch:
        lists = pc.ascii_split_whitespace(texts)
        words, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        filled = pc.not_equal(pc.binary_length(words), 0)
        words, doc = words.filter(filled).dictionary_encode(), doc[filled.to_numpy(zero_copy_only=False)]
        length = np.bincount(doc, minlength=len(docs))
        place, counts = np.unique(words.indices.to_numpy().astype(np.int64) * len(docs) + doc, return_counts=True)
        token, at = np.divmod(place, len(docs))
        first = np.flatnonzero(np.diff(token, prepend=-1))
        # the row of the null token comes last
        size = np.append(np.diff(np.append(first, len(token))), len(docs))
        at, counts = np.concatenate([at, np.arange(len(docs))]), np.concatenate([counts, length])
        first = np.append(first, len(token))
        cuts = pa.array(np.append(first, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, x) for x in (docs.take(pa.array(at)), pa.array(counts, pa.int32()), pa.array(length[at], pa.int32()))]
        names = pa.concat_arrays([words.dictionary.take(pa.array(token[first[:-1]])).cast(pa.string()), pa.nulls(1, pa.string())])
        return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(size), cell)), pa.array(size, pa.int64()), pa.array(np.maximum.reduceat(counts, first), pa.int32()), pa.array(np.minimum.reduceat(length[at], first), pa.int32()), *lists], ["token", "cell", "n", "most", "least", "docs", "counts", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, CELL):
                part = batch.slice(begin, CELL)
                yield cell_rows(part.column("d"), part.column("text"), (part.column("part")[0].as_py() << 32) + number)
                number += 1

    return rows.mapInArrow(run, f"token string, cell long, n long, most int, least int, docs array<{kind}>, counts array<int>, lengths array<int>")


def add(docs: DataFrame, path: str, run: int = 0, id_col: str = "doc_id", text_col: str = "text", mode: str = "append") -> None:
    """Writes the rows of a run; cells of different runs are different ones."""
    folder = F.when(F.col("token").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("token"), F.lit(FOLDERS))).cast("int")
    rows = postings_of(docs, id_col, text_col).select("*", F.lit(run).cast("long").alias("run"), folder.alias("folder"))
    parts = max(FOLDERS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a folder's rows go to as many tasks as there are to a folder; one token's cells may be in several
    spread = F.pmod(F.xxhash64("token", F.shiftright("cell", 5)), F.lit(max(1, parts // FOLDERS)))
    rows.repartition(parts, "folder", spread).sortWithinPartitions("folder", "token", "run", "cell").write.mode(mode).partitionBy("folder").parquet(path)


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The rows of an index; of one that is not there, none."""
    shape = T.StructType.fromDDL(f"token string, cell long, n long, most int, least int, docs array<{id_type}>, counts array<int>, lengths array<int>, run long, folder int")
    return spark.read.schema(shape).parquet(path) if has_data(spark, path) else spark.createDataFrame([], shape)


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: number of documents and mean length in tokens, from the sums of the cells."""
    sums = index.where("token IS NULL").select("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"))
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.try_divide(F.sum("t"), F.sum("n")).alias("avg_len"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("df"))


def saturated(count: Column, length: Column, average: float, w: Weights) -> Column:
    """How much a token counts that a document has so often; it grows with the count and falls with the length."""
    return count * (w.k1 + 1) / (count + w.k1 * (1 - w.b + w.b * length / average))


def weighted(index: DataFrame, questions: DataFrame, w: Weights, q_col: str, q_text: str) -> tuple[DataFrame, float]:
    """(q, token, weight) of the tokens asked, and the mean length of the documents."""
    stats = corpus_stats(index).first()
    asked = questions.select(F.col(q_col).alias("q"), F.explode(tokens(q_text)).alias("token")).groupBy("q", "token").agg(F.count("*").alias("times"))
    counts = index.where("token IS NOT NULL").select("token", F.col("n").alias("df"))
    return idf_weights(counts, asked, stats.n_docs, w.epsilon), stats.avg_len or 1.0


def measured(weights: DataFrame) -> int:
    """Bytes of the tokens asked, roughly."""
    return weights.agg(F.coalesce(F.sum(F.octet_length("token") + 64), F.lit(0))).first()[0]


def bounds(index: DataFrame, weights: DataFrame, average: float, w: Weights, n_bytes: int | None = None) -> DataFrame:
    """(q, run, cell, bound): what a document of the cell scores at most, where it has a token of the question."""
    heads = index.select("token", "run", "cell", saturated(F.col("most"), F.col("least"), average, w).alias("at_most"))
    # a weight below 0 takes nothing from the bound
    n_bytes = measured(weights) if n_bytes is None else n_bytes
    return heads.join(small(weights, n_bytes), "token").groupBy("q", "run", "cell").agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * F.col("at_most")).alias("bound"))


def scored(index: DataFrame, pairs: DataFrame, weights: DataFrame, average: float, k: int, w: Weights, blocks: int, n_bytes: int, n_cells: int) -> DataFrame:
    """(q, d, score): of each pair (q, run, cell) the best k documents above 0, and those below 0, which only tokens of most documents can give."""
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    lists = weights.groupBy("q").agg(F.collect_list(F.struct("token", "weight")).alias("asked"))
    met = pairs.select("q", "run", "cell").join(small(lists, n_bytes), "q").select(F.col("run").alias("run"), F.col("cell").alias("cell"), block.alias("block"), F.col("q").alias("q"), F.col("asked.token").alias("tokens"), F.col("asked.weight").alias("weights"))
    cells = pairs.select("run", "cell", block.alias("block")).distinct()
    rows = index.join(small(weights.select("token").distinct(), n_bytes), "token", "left_semi").select("token", "run", "cell", "docs", "counts", "lengths")
    rows = rows.join(small(cells, 64 * n_cells * blocks), ["run", "cell"]).select(F.col("run").alias("run"), F.col("cell").alias("cell"), F.col("block").alias("block"), "token", "docs", "counts", "lengths")
    kind, q_kind = index.schema["docs"].dataType.elementType.simpleString(), pairs.schema["q"].dataType.simpleString()

    def run(posted: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["q", "d", "score"]
        q_type, d_type = asked.schema.field("q").type, posted.schema.field("docs").type.value_type
        if not posted.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in (q_type, d_type, pa.float64())], names)
        posted, asked = posted.combine_chunks(), asked.combine_chunks()
        lists = posted.column("docs").chunk(0)
        parent = pc.list_parent_indices(lists).to_numpy()
        docs = lists.flatten().dictionary_encode()
        place = docs.indices.to_numpy()
        count, length = (posted.column(c).chunk(0).flatten().to_numpy().astype(float) for c in ("counts", "lengths"))
        given = np.zeros((posted.num_rows, len(docs.dictionary)))
        given[parent, place] = count * (w.k1 + 1) / (count + w.k1 * (1 - w.b + w.b * length / average))
        said = asked.column("tokens").chunk(0)
        token = pc.index_in(said.flatten(), posted.column("token").chunk(0)).to_numpy(zero_copy_only=False)
        known = ~np.isnan(token)
        weight = np.zeros((asked.num_rows, posted.num_rows))
        weight[pc.list_parent_indices(said).to_numpy()[known], token[known].astype(np.int64)] = asked.column("weights").chunk(0).flatten().to_numpy()[known]
        scores = np.round(weight @ given, 6) + 0.0
        ids = docs.dictionary
        by_id = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        order = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]
        best = np.take_along_axis(scores, order, 1)
        i, j = np.nonzero(best > 0)
        below = np.nonzero(scores < 0)  # all of them, as they are no documents of score 0
        i, j, values = np.append(i, below[0]), np.append(order[i, j], below[1]), np.append(best[i, j], scores[below])
        return pa.table([asked.column("q").take(pa.array(i)), ids.take(pa.array(j)), pa.array(values)], names)

    keys = ["run", "cell", "block"]
    return rows.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(run, f"q {q_kind}, d {kind}, score double")


def topk(index: DataFrame, questions: DataFrame, k: int, q_col: str = "item_id", q_text: str = "text", id_col: str = "doc_id", w: Weights = Weights(), lead: int = LEAD, block: int = BLOCK) -> DataFrame:
    """(question, id, score, rank): the results of ``retrieval.bm25_topk`` over the documents of an index."""
    k = max(1, k)
    bounded_batches(index.sparkSession)
    names = questions.select(F.col(q_col).alias("q")).distinct()
    weights, average = weighted(index, questions, w, q_col, q_text)
    weights = kept(weights)
    blocks = max(1, -(-names.count() // block))
    n_bytes, n_cells = measured(weights), index.where("token IS NULL").count()
    found = kept(bounds(index, weights, average, w, n_bytes).withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "run", "cell"))))
    first = kept(scored(index, found.where(F.col("place") <= lead), weights, average, k, w, blocks, n_bytes, n_cells))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    least = first.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select("q", F.col("score").alias("least"))
    # without k documents so far, or with fewer than k above 0, all cells count
    open_ = found.where(F.col("place") > lead).join(least, "q", "left").where(F.col("least").isNull() | (F.col("least") <= 0) | (F.col("bound") >= F.col("least") - SLACK))
    hits = kept(first.unionByName(scored(index, open_, weights, average, k, w, blocks, n_bytes, n_cells)))
    ranked = hits.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k)
    return _filled(index, names, ranked.select("q", "d", "score"), hits, k).select(F.col("q").alias(q_col), F.col("d").alias(id_col), "score", "rank")


def _filled(index: DataFrame, names: DataFrame, ranked: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The best k of each question, with documents of score 0, by id, where fewer than k are above 0."""
    above = ranked.where("score > 0").groupBy("q").agg(F.count("*").alias("above"))
    short = names.join(above, "q", "left").where(F.coalesce("above", F.lit(0)) < k).select("q")
    other = hits.join(short, "q", "left_semi").groupBy("q").agg(F.count("*").alias("n"))
    # the k smallest ids beside those that have a score of their own
    most = other.agg(F.max("n")).first()[0] or 0
    pool = index.where("token IS NULL").select(F.explode("docs").alias("d")).orderBy("d").limit(k + most).agg(F.collect_list("d").alias("ids"))
    filling = short.crossJoin(F.broadcast(pool)).select("q", F.explode("ids").alias("d")).join(hits.select("q", "d"), ["q", "d"], "left_anti")
    every = ranked.unionByName(filling.select("q", "d", F.lit(0.0).alias("score")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    return every.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
