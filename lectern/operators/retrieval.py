"""Sparse, dense and fused retrieval for whole sets of questions.

The corpus is read once. Slices of it meet blocks of questions, both of a bounded size, as
rows of a join: small sets of questions are broadcast, larger ones shuffled. A task scores
by matrix products and keeps the best k of each question. Neither documents nor
questions gather on the driver, but for one bounded block of question vectors.
Ties always end in the smaller document id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_weights, strip
from .batches import bounded_batches, bounded_reads
from .scratch import kept, new_folder

#: Numbers of the largest matrix in a task: 32 MB of weights, or of vectors.
BLOCK_CELLS = 4_000_000
#: Documents and bytes of text of a slice; questions of a block; bytes of all blocks that are broadcast.
#: A slice of 256 kB is arrays of half a megabyte, which the JVM moves like other objects; larger ones it collects late.
SLICE, SLICE_BYTES, BLOCK, BROADCAST_BYTES = 512, 1 << 18, 256, 16 << 20
#: Slices of a row group of their file: Spark's reader holds a row group of such wide rows at once, with a level for each number.
GROUP = 1
#: Vectors of a slice, and of a block of questions.
VECTORS = 1024


def tokens(c: str) -> Column:
    """White-space tokens, case kept."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")


# --- sparse -------------------------------------------------------------------------------------


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: number of documents and mean length in tokens."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens(text_col))).alias("avg_len"))


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(F.array_distinct(tokens(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def raw_idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def idf_table(df: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(token, df, idf); negative values become ``epsilon`` times the mean of all raw ones."""
    raw = df.crossJoin(F.broadcast(stats)).select("token", "df", raw_idf(F.col("n_docs"), F.col("df")).alias("raw"))  # stats is one row
    mean = raw.agg(F.avg("raw").alias("mean_raw"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, F.col("mean_raw") * epsilon).otherwise(F.col("raw")).alias("idf"))


def sliced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tokens, df, docs, lengths, doc, count): sparse count matrices of up to ``SLICE`` documents.

    ``df`` says how many of the slice's documents have each token; ``doc`` and ``count`` hold
    their places and how often they have it, token after token. A null text is an empty one.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(text_col, F.lit("")).alias("text"))

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = pc.ascii_split_whitespace(part.column("text"))
        words, doc, n = lists.flatten(), pc.list_parent_indices(lists).to_numpy(), part.num_rows
        filled = pc.not_equal(pc.binary_length(words), 0)
        words, doc = words.filter(filled).dictionary_encode(), doc[filled.to_numpy(zero_copy_only=False)]
        place, count = np.unique(words.indices.to_numpy().astype(np.int64) * n + doc, return_counts=True)
        token, at = np.divmod(place, n)
        kinds = len(words.dictionary)
        columns = [words.dictionary.cast(pa.string()), np.bincount(token, minlength=kinds), part.column("d"), np.bincount(doc, minlength=n), at, count]
        columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int32()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["tokens", "df", "docs", "lengths", "doc", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64)
            begin = 0
            while begin < batch.num_rows:
                most = (end[begin - 1] if begin else 0) + SLICE_BYTES
                size = max(1, min(SLICE, int(np.searchsorted(end, most, "right")) - begin))
                yield one(batch.slice(begin, size))
                begin += size

    kind = rows.schema["d"].dataType.simpleString()
    return rows.mapInArrow(run, f"tokens array<string>, df array<int>, docs array<{kind}>, lengths array<int>, doc array<int>, count array<int>")


def token_weights(slices: DataFrame, asked: DataFrame, epsilon: float) -> tuple[DataFrame, float]:
    """(q, token, weight) of the tokens asked (q, token, times) that some document has, and the mean length of the documents."""
    total = slices.agg(F.sum(F.size("docs")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("t")).first()
    n_docs, average = total.n or 0, (total.t or 0) / (total.n or 1) or 1.0
    counts = slices.select("df", F.posexplode("tokens").alias("at", "token")).select("token", F.get("df", F.col("at")).alias("df"))
    return idf_weights(counts, asked, n_docs, epsilon), average


def idf_weights(counts: DataFrame, asked: DataFrame, n_docs: int, epsilon: float) -> DataFrame:
    """(q, token, weight) of the tokens asked (q, token, times) that are among the counts (token, df), which add up."""
    # one shuffle of the counts, with the tokens that are asked among them: the sum of all raw idf, and the asked tokens' own
    wanted = asked.select("token", F.lit(0).alias("df"), F.lit(True).alias("asked")).distinct()
    df = counts.withColumn("asked", F.lit(False)).unionByName(wanted).groupBy("token").agg(F.sum("df").alias("df"), F.max("asked").alias("asked")).where("df > 0")
    raw = df.select(F.when(F.col("asked"), F.col("token")).alias("token"), raw_idf(F.lit(n_docs), F.col("df")).alias("raw"))
    held = kept(raw.groupBy("token").agg(F.sum("raw").alias("raw"), F.count("*").alias("n")))
    mean = held.agg(F.try_divide(F.sum("raw"), F.sum("n"))).first()[0] or 0.0
    idf = F.when(F.col("raw") < 0, F.lit(mean * epsilon)).otherwise(F.col("raw"))
    return asked.join(held, "token").select("q", "token", (F.col("times") * idf).alias("weight"))


def small(rows: DataFrame, n_bytes: int) -> DataFrame:
    """Rows of ``n_bytes`` in all, broadcast where that is at most ``BROADCAST_BYTES``."""
    return F.broadcast(rows) if n_bytes <= BROADCAST_BYTES else rows


def with_texts(hits: DataFrame, n_hits: int, texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits, ``n_hits`` at most, with their documents' columns: few are broadcast, so that no text is shuffled or sorted for them."""
    return texts.join(small(hits, 64 * n_hits), id_col)


def dealt(slices: DataFrame, blocks: DataFrame, n_blocks: int, n_bytes: int, key: str) -> DataFrame:
    """Every slice with every block of questions, each pair one row; ``blocks`` has (block, …), of ``n_bytes`` in all.

    Blocks of up to ``BROADCAST_BYTES`` are broadcast and slices stay where they are. Beyond
    that both cross a shuffle, by block and a hash of the slice, so that no task holds more
    than its share of the slices of one block.
    """
    every = slices.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1)))))
    if n_bytes <= BROADCAST_BYTES:
        return every.join(F.broadcast(blocks), "block")
    salts = -(-int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_blocks)
    every = every.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    return every.join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["block", "salt"])


def bm25_topk(docs: DataFrame, questions: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", q_col: str = "item_id", q_text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, block: int = BLOCK) -> DataFrame:
    """(question, id, score, rank): k documents for each question, those without a hit with score 0.

    One scan of the texts, for any number of questions: slices of counts are written to the
    shared folder, and all else reads those. No token and no question comes to the driver. A
    token asked twice counts twice. Ids must not be null.
    """
    k, spark = max(1, k), docs.sparkSession
    bounded_reads(spark)
    path, rows = new_folder(spark), sliced(docs, id_col, text_col)
    # a slice has each token once, so a dictionary of them would only be held
    rows.write.option("parquet.block.row.count.limit", GROUP).option("parquet.enable.dictionary#tokens.list.element", "false").parquet(path)
    slices = spark.read.schema(rows.schema).parquet(path)
    names = questions.select(F.col(q_col).alias("q")).distinct()
    asked = questions.select(F.col(q_col).alias("q"), F.explode(tokens(q_text)).alias("token")).groupBy("q", "token").agg(F.count("*").alias("times"))
    weights, average = token_weights(slices, asked, epsilon)
    # a question none of whose tokens is known is there, too
    entries = kept(weights.unionByName(names.select("q", F.lit(None).cast("string").alias("token"), F.lit(0.0).alias("weight"))))
    size = entries.agg(F.count_if(F.col("token").isNull()).alias("questions"), F.coalesce(F.sum(F.coalesce(F.octet_length("token"), F.lit(0)) + 64), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size.questions // block))
    blocks = entries.groupBy(F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("q", "token", "weight"))).alias("asked"))
    # three plain arrays, which every slice's row copies as they are
    blocks = blocks.select("block", "asked.q", F.col("asked.token").alias("token"), "asked.weight")
    met = dealt(slices, blocks, n_blocks, size.bytes, "docs").select("block", "tokens", "df", "docs", "lengths", "doc", "count", "q", "token", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best, cells = None, {}, 0
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                x = {c: batch.column(c)[row].values for c in batch.schema.names if c != "block"}
                if block != last:  # one block's matrix at a time
                    last, asked = block, _asked(x)
                for ids, scores in _scored(x, *asked[1:], average, k, k1, b):
                    if block in best:
                        ids, scores = _better(*best[block][1:], ids, scores, k)
                        cells -= best[block][2].size
                    best[block], cells = (asked[0], ids, scores), cells + scores.size
                if cells > BLOCK_CELLS:
                    yield from map(_hits, best.values())
                    best, cells = {}, 0
        yield from map(_hits, best.values())

    types = (names.schema["q"].dataType.simpleString(), slices.schema["docs"].dataType.elementType.simpleString())
    scored = met.mapInArrow(run, "q {}, d {}, score double".format(*types))
    return _ranked(scored, k).select(F.col("q").alias(q_col), F.col("d").alias(id_col), "score", "rank")


def _asked(x: dict[str, pa.Array]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """A block's questions, the tokens they ask and the weight of each token in each question."""
    names = x["q"].dictionary_encode(null_encoding="encode")
    vocabulary = x["token"].drop_null().unique()
    token = pc.index_in(x["token"], vocabulary, skip_nulls=True).to_numpy(zero_copy_only=False)
    said = ~np.isnan(token)
    matrix = np.zeros((len(vocabulary), len(names.dictionary)))
    np.add.at(matrix, (token[said].astype(np.int64), names.indices.to_numpy()[said]), x["weight"].to_numpy()[said])
    return names.dictionary, vocabulary, matrix


def _scored(x: dict[str, pa.Array], vocabulary: pa.Array, matrix: np.ndarray, average: float, k: int, k1: float, b: float) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Of a slice's documents the best k for each question of a block: ids, question after question, and scores."""
    width, questions = matrix.shape
    # the slice's counts of asked tokens, document after document
    df = x["df"].to_numpy()
    known = pc.index_in(x["tokens"], vocabulary).to_numpy(zero_copy_only=False)
    column = np.repeat(known, df)
    hit = ~np.isnan(column)
    doc, column, tf = x["doc"].to_numpy()[hit], column[hit].astype(np.int64), x["count"].to_numpy()[hit].astype(float)
    value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * x["lengths"].to_numpy()[doc] / average))
    order = np.argsort(doc, kind="stable")
    doc, column, value = doc[order], column[order], value[order]
    step = max(1, BLOCK_CELLS // max(1, width, questions))
    for begin in range(0, len(x["docs"]), step):
        ids = x["docs"].slice(begin, step)
        i, j = np.searchsorted(doc, (begin, begin + len(ids)))
        weight = np.zeros((len(ids), width))
        weight[doc[i:j] - begin, column[i:j]] = value[i:j]
        scores = np.round(weight @ matrix, 6).T + 0.0  # no negative zero
        by_id = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        best = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]
        yield ids.take(pa.array(best.ravel())), np.take_along_axis(scores, best, 1)


def _better(ids: pa.Array, scores: np.ndarray, more: pa.Array, more_scores: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The best k for each question out of two lists of hits."""
    every, both = pa.concat_arrays([ids, more]), np.hstack([scores, more_scores])
    at = np.hstack([np.arange(scores.size).reshape(scores.shape), scores.size + np.arange(more_scores.size).reshape(more_scores.shape)])
    place = np.argsort(np.argsort(every.to_numpy(zero_copy_only=False), kind="stable"))
    best = np.lexsort((place[at], -both), axis=1)[:, :k]
    return every.take(pa.array(np.take_along_axis(at, best, 1).ravel())), np.take_along_axis(both, best, 1)


def _hits(found: tuple[pa.Array, pa.Array, np.ndarray]) -> pa.RecordBatch:
    names, ids, scores = found
    q = names.take(pa.array(np.repeat(np.arange(len(scores)), scores.shape[1])))
    return pa.RecordBatch.from_arrays([q, ids, pa.array(scores.ravel())], ["q", "d", "score"])


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


# --- dense --------------------------------------------------------------------------------------


def _usable(v: str) -> Column:
    """Whether a vector has a direction: not null, without null or non-finite components, not zero."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return _unit(column.flatten(), rows)


def _unit(values: pa.Array, rows: int) -> np.ndarray:
    x = values.to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)
    x /= np.abs(x).max(1, keepdims=True)  # squares of tiny or huge components stay doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(names: pa.Array, q: np.ndarray, ids: pa.Array, x: np.ndarray, k: int) -> pa.RecordBatch:
    """(q, d, score): of some vectors the best k for each question."""
    scores = np.round(q @ x.T, 6)
    # all that tie with the k-th stay, so that ids decide later
    least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None] if k < len(ids) else -2.0
    i, j = np.nonzero(scores >= least)
    return pa.RecordBatch.from_arrays([names.take(pa.array(i)), ids.take(pa.array(j)), pa.array(scores[i, j])], ["q", "d", "score"])


def dense_topk(vectors: DataFrame, questions: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = VECTORS) -> DataFrame:
    """(q, id, score, rank) by cosine in double precision, rounded to 6 digits; ``questions`` has (q, v).

    Vectors that are null, zero or hold null or non-finite components are in no
    result, and such questions have none. All vectors are of one length. Up to ``block``
    questions go to the tasks by the driver; more of them meet slices of vectors by a join.
    """
    bounded_batches(vectors.sparkSession)
    asked = questions.where(_usable("v")).select("q", F.col("v").cast("array<double>").alias("v"))
    rows = vectors.where(_usable(vector_col)).select(F.col(id_col).alias("d"), F.col(vector_col).alias("v"))
    shape = f"q {questions.schema['q'].dataType.simpleString()}, d {vectors.schema[id_col].dataType.simpleString()}, score double"
    few = asked.limit(block + 1).toArrow()
    scored = _near_few(rows, few, k, shape) if few.num_rows <= block else _near_many(rows, asked, k, shape, block)
    return _ranked(scored, k).withColumnRenamed("d", id_col)


def _near_few(rows: DataFrame, few: pa.Table, k: int, shape: str) -> DataFrame:
    spread = rows.sparkSession.sparkContext.broadcast(few.combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = spread.value
        if not few.num_rows:
            return
        names, q = few.column("q").combine_chunks(), _matrix(few.column("v").combine_chunks(), few.num_rows)
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTORS):
                part = batch.slice(begin, VECTORS)
                yield _nearest(names, q, part.column("d"), _matrix(part.column("v"), part.num_rows), k)

    return rows.mapInArrow(run, shape)


def _near_many(rows: DataFrame, asked: DataFrame, k: int, shape: str, block: int) -> DataFrame:
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("v") * 8 + 64).alias("bytes")).first()
    n_blocks = -(-size.n // block)
    blocks = asked.groupBy(F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("q", "v")).alias("asked"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTORS):
                part = batch.slice(begin, VECTORS)
                columns = [part.column("d"), part.column("v").flatten().cast(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["docs", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, v, ids, x = (batch.column(c)[row].values for c in ("q", "v", "docs", "x"))
                yield _nearest(names, _unit(v.flatten(), len(names)), ids, _unit(x, len(ids)), k)

    sliced = rows.mapInArrow(slices, f"docs array<{rows.schema['d'].dataType.simpleString()}>, x array<double>")
    met = dealt(sliced, blocks, n_blocks, size.bytes, "docs").select("docs", "x", "asked.q", "asked.v")
    return met.mapInArrow(run, shape)


def mmr(vectors: DataFrame, questions: DataFrame, k: int, fetch: int = 20, weight: float = 0.5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(q, id, rank): the nearest, then each time the one that is near the question and unlike those taken.

    The pool of ``fetch`` candidates a question bounds each group.
    """
    pool = dense_topk(vectors, questions, fetch, id_col, vector_col).join(vectors.select(id_col, vector_col), id_col)
    q_type, kind = questions.schema["q"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rank", "ascending")]).combine_chunks()
        x = _matrix(table.column(vector_col).combine_chunks(), table.num_rows)
        near, alike = table.column("score").to_numpy(), np.round(x @ x.T, 6)
        ids = table.column(id_col)
        # of equal values the smaller id goes first
        by_id = np.argsort(ids.to_numpy(), kind="stable")
        taken: list[int] = []
        worst, open_ = np.zeros(len(near)), np.ones(len(near), bool)
        while len(taken) < min(k, len(near)):
            value = np.where(open_, np.round(weight * near - (1 - weight) * worst, 6) if taken else near, -np.inf)[by_id]
            best = int(by_id[value.argmax()])
            worst = alike[best] if not taken else np.maximum(worst, alike[best])
            taken.append(best)
            open_[best] = False
        return pa.table([table.column("q").slice(0, 1).take(pa.array(np.zeros(len(taken), np.int64))), ids.take(pa.array(taken)), pa.array(np.arange(1, len(taken) + 1))], ["q", id_col, "rank"])

    return pool.groupBy("q").applyInArrow(run, f"q {q_type}, `{id_col}` {kind}, rank long")


# --- fusion -------------------------------------------------------------------------------------


def doc_key(source: Column, text: Column, page: Column | None = None, chunk: Column | None = None) -> Column:
    """What makes two retrieved rows the same document: source, page, chunk and trimmed text."""
    text_of = lambda c: F.lit("") if c is None else F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(text_of(source).alias("source"), text_of(page).alias("page"), text_of(chunk).alias("chunk_id"), strip(F.coalesce(text, F.lit(""))).alias("text"))


def rrf(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float, sparse_weight: float, rrf_k: int = 60) -> DataFrame:
    """(q, key, d, score, rank) from rows (q, key, d, rank), ranks from 1: weighted reciprocal ranks, summed by key."""
    both = [rows.select("q", "key", "d", "rank", F.lit(i).alias("src")) for i, rows in enumerate((dense, sparse))]
    return rrf_of(both[0].unionByName(both[1]), k, dense_weight, sparse_weight, rrf_k)


def rrf_of(hits: DataFrame, k: int, dense_weight: float, sparse_weight: float, rrf_k: int = 60) -> DataFrame:
    """The same from one table, whose ``src`` is 0 for dense and 1 for sparse rows.

    A tie goes to the dense list's order, then the sparse one's; a key in both lists
    is represented by its last sparse document.
    """
    w = normalize_weights(dense_weight, sparse_weight)
    part = F.when(F.col("src") == 0, F.lit(w[0])).otherwise(F.lit(w[1])) / (rrf_k + F.col("rank"))
    place = F.struct("src", F.col("rank").cast("long"))
    summed = hits.groupBy("q", "key").agg(F.round(F.sum(part), 9).alias("score"), F.min(place).alias("first"), F.max_by("d", place).alias("d"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    return summed.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= max(1, k)).drop("first")


def build_retriever(docs: DataFrame, vectors: DataFrame, mode: str, top_k: int, sparse_k: int, weights: tuple[float, float], rrf_k: int = 60, fetch: int = 20, weight: float = 0.5):
    """A function of (questions, question vectors) to (q, doc_id, score, rank). Without texts, or in another mode than ``hybrid``, dense results only."""
    texts = docs.select("doc_id", "source", F.nullif(strip(F.coalesce("text", F.lit(""))), F.lit("")).alias("text")).where("text IS NOT NULL")
    top_k, sparse_k = max(1, top_k), max(1, sparse_k)

    def retrieve(questions: DataFrame, asked: DataFrame) -> DataFrame:
        near = mmr(vectors.withColumnRenamed("vec_id", "doc_id") if "vec_id" in vectors.columns else vectors, asked, top_k, fetch, weight, id_col="doc_id")
        if mode != "hybrid" or texts.isEmpty():
            return near.withColumn("score", F.lit(None).cast("double")).select("q", "doc_id", "score", "rank")
        keyed = lambda rows: rows.join(texts, "doc_id").select("q", doc_key(F.col("source"), F.col("text")).alias("key"), F.col("doc_id").alias("d"), "rank")
        found = bm25_topk(texts, questions, sparse_k).withColumnRenamed("item_id", "q")
        return rrf(keyed(near), keyed(found), top_k, *weights, rrf_k).select("q", F.col("d").alias("doc_id"), "score", "rank")

    return retrieve


# --- context and prompts ------------------------------------------------------------------------


def prepare_contexts(texts: Column, most: int, chars: int) -> Column:
    """The first ``most`` texts, of those the non-blank ones, each cut to ``chars``."""
    return F.transform(F.filter(F.slice(texts, 1, max(1, most)), lambda t: t.isNotNull() & (strip(t) != "")), lambda t: F.left(t, F.lit(chars)))


def stuffed_prompt(hits: DataFrame, questions: DataFrame, system: str, joiner: str = "\n\n") -> DataFrame:
    """(q, prompt): the system text with the question's contexts in order, then the question."""
    context = hits.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), joiner).alias("context"))
    asked = questions.join(context, "q", "left")
    return asked.select("q", F.concat(F.replace(F.lit(system), F.lit("{context}"), F.coalesce("context", F.lit(""))), F.lit("\n\nHuman: "), "question").alias("prompt"))


def source_text(result: Column, is_json: bool = False) -> Column:
    """The text of a retrieved item that is a plain string, or JSON of an object with ``page_content`` or ``text``; other JSON gives null."""
    if not is_json:
        return result
    item = F.from_json(result, "page_content string, text string")
    return F.when(F.ltrim(result).startswith("{"), F.coalesce(item["page_content"], item["text"])).when(F.ltrim(result).rlike(r'^[\[0-9tfn-]'), F.lit(None).cast("string")).otherwise(F.regexp_replace(result, r'^\s*"|"\s*$', ""))
