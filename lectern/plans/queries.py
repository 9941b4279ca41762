"""The library's operators over the test tables, one query each.

``documents`` are the ingested texts, ``benchmark`` the questions, ``embeddings`` the
dense index (the vector of a question's number is the question's; dense searches of their
own ask with every hundredth vector), ``conversations`` the
chat log and ``labels`` the verdicts. Layout blocks are derived from the documents'
lines by fixed arithmetic, so that SQL can derive the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonfix, tables
from ..functions import text as T
from ..operators import blocks as B
from ..operators import cells
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import history as H
from ..operators import ingest as I
from ..operators import postings, ranges
from ..operators import retrieval as R
from ..operators import scratch, sketches

#: Parameters that the SQL shares.
TOP_K, SPARSE_K, FETCH, RRF_K, WEIGHTS, EVERY = 4, 8, 20, 60, (0.6, 0.4), 100
SIZE, OVERLAP = 1000, 400


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def derived_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    r = F.pmod(F.col("doc_id") + F.col("i"), F.lit(11))
    kind = F.when(r == 0, "table").when(r == 1, "image").when(r == 2, "equation").when(r == 3, "discarded").otherwise("text")
    none = F.lit(None)
    only = lambda t, c: F.when(kind == t, c)
    box = [F.pmod("i", F.lit(4)) * 50, F.pmod("doc_id", F.lit(7)) * 20, F.pmod("i", F.lit(4)) * 50 + 100, F.pmod("doc_id", F.lit(7)) * 20 + 40]
    return rows.select(
        "doc_id",
        F.col("i").alias("block_idx"),
        kind.alias("type"),
        F.when(kind.isin("text", "equation", "discarded"), F.col("line")).alias("text"),
        only("text", F.when(F.pmod(F.col("doc_id") * 7 + F.col("i"), F.lit(5)) == 0, (1 + F.pmod("i", F.lit(3))).cast("int"))).alias("text_level"),
        F.array(*[b.cast("int") for b in box]).alias("bbox"),
        F.floor(F.col("i") / 4).cast("int").alias("page_idx"),
        only("image", F.concat(F.lit("img/"), F.col("i").cast("string"), F.lit(".png"))).alias("img_path"),
        only("image", F.array(F.left("line", F.lit(40)))).alias("image_caption"),
        none.cast("array<string>").alias("image_footnote"),
        only("table", F.array(F.left("line", F.lit(30)))).alias("table_caption"),
        none.cast("array<string>").alias("table_footnote"),
        only("table", F.concat(F.lit("<tr><td>"), F.col("line"), F.lit("</td></tr>"))).alias("table_body"),
        none.cast("string").alias("llm_description"),
    )


def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return read(spark, sf_dir, "embeddings").join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))


# --- text functions -----------------------------------------------------------------------------


def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.normalize_text("text").alias("norm"))


def strip_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.strip_html("html").alias("stripped"))


def session_id_normalize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.session_id("url").alias("session_id"))


def preview_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.preview("text", 200).alias("preview"))


def source_keys(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.source_key(F.lit("markdown"), F.col("url")).alias("key"), T.file_name("url").alias("name"))


def retry_budgets(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("attempt"))
    return rows.select("attempt", T.predict_tokens(F.lit(100).cast("long"), F.pmod("attempt", F.lit(5)), 1.5, 512).alias("num_predict"))


def failure_predicates(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.failure_has(F.col("props"), "ERR", "timeout", "\"k\"").alias("failed"))


def metadata_sanitize(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.struct("lang", "n_chars").alias("meta"), F.array("source", "lang").alias("tags"))
    return I.flat_metadata(rows, "meta", "tags")


def json_recover(spark, sf_dir):
    text = F.concat(F.lit('Sure: {"id": '), F.col("item_id").cast("string"), F.lit(', "path": "C:\\temp\\q", "text": '), F.to_json(F.struct("text")), F.lit("} done"))
    return read(spark, sf_dir, "benchmark").select("item_id", jsonfix.recover_col(text).alias("json"))


# --- sparse retrieval ---------------------------------------------------------------------------


def token_stats(spark, sf_dir):
    return R.corpus_stats(documents(spark, sf_dir)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def run_sketches(spark, sf_dir):
    """Statistics of each source's texts, kept as if each had been an ingest run."""
    path = scratch.new_folder(spark)
    sketches.add(documents(spark, sf_dir), path, "source")
    return sketches.read(spark, path)


def token_stats_merged(spark, sf_dir):
    """``token_stats`` from the runs' rows, without counting again."""
    return sketches.estimates(sketches.merged(run_sketches(spark, sf_dir))).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def corpus_sketches(spark, sf_dir):
    """Estimated distinct tokens and length quantiles of the whole corpus, from the runs' rows."""
    return sketches.estimates(sketches.merged(run_sketches(spark, sf_dir)))


def document_frequency(spark, sf_dir):
    return R.document_frequency(documents(spark, sf_dir))


def bm25_idf_epsilon(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return R.idf_table(R.document_frequency(docs), R.corpus_stats(docs)).select("token", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    return R.bm25_topk(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"), SPARSE_K)


def bm25_postings(spark, sf_dir):
    """The best documents from a stored inverted index, which is built first."""
    path = scratch.new_folder(spark)
    postings.add(documents(spark, sf_dir), path)
    return postings.topk(postings.read(spark, path), read(spark, sf_dir, "benchmark"), SPARSE_K)


# --- dense retrieval and fusion -----------------------------------------------------------------


def dense_topk(spark, sf_dir):
    return R.dense_topk(read(spark, sf_dir, "embeddings"), search_vectors(spark, sf_dir), TOP_K)


def dense_lists(spark, sf_dir):
    """The nearest vectors from the lists of a stored quantiser, which is built first; all lists that may hold one of them are read."""
    path = scratch.new_folder(spark)
    cells.build(read(spark, sf_dir, "embeddings"), path)
    return cells.search(spark, path, search_vectors(spark, sf_dir), TOP_K, exact=True)


def dense_mmr(spark, sf_dir):
    return R.mmr(read(spark, sf_dir, "embeddings"), search_vectors(spark, sf_dir), TOP_K, FETCH)


def fused(spark, sf_dir, weights):
    near = R.mmr(read(spark, sf_dir, "embeddings"), question_vectors(spark, sf_dir), TOP_K, FETCH).withColumnRenamed("vec_id", "doc_id")
    found = bm25_topk(spark, sf_dir).withColumnRenamed("item_id", "q")
    # one join of the few hits with the texts
    hits = near.select("q", "doc_id", "rank", F.lit(0).alias("src")).unionByName(found.select("q", "doc_id", "rank", F.lit(1).alias("src")))
    n_hits = read(spark, sf_dir, "benchmark").count() * (TOP_K + SPARSE_K)
    texts = R.with_texts(hits, n_hits, documents(spark, sf_dir).select("doc_id", "source", "text"))
    keyed = texts.select("q", F.col("doc_id").alias("d"), "rank", "src", R.doc_key(F.col("source"), F.col("text")).alias("key"))
    return R.rrf_of(keyed, TOP_K, *weights, RRF_K).select("q", F.col("d").alias("doc_id"), "score", "rank")


def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir, WEIGHTS)


def rrf_dense_only(spark, sf_dir):
    return fused(spark, sf_dir, (1.0, -1.0))


def rrf_zero_weights(spark, sf_dir):
    return fused(spark, sf_dir, (0.0, 0.0))


def dedup_doc_key(spark, sf_dir):
    key = R.doc_key(F.col("source"), F.col("text"))
    return documents(spark, sf_dir).groupBy(key.alias("k")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).select("first_id", "n")


def prepare_contexts(spark, sf_dir):
    hits = R.with_texts(bm25_topk(spark, sf_dir), read(spark, sf_dir, "benchmark").count() * SPARSE_K, documents(spark, sf_dir).select("doc_id", "text"))
    rows = hits.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    return rows.select("item_id", F.posexplode(R.prepare_contexts(F.col("texts"), 3, 120)).alias("pos", "context")).select("item_id", F.col("pos").cast("long").alias("pos"), "context")


def prompt_assembly(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark")
    hits = R.with_texts(rrf_fusion(spark, sf_dir), rows.count() * TOP_K, documents(spark, sf_dir).select("doc_id", "text"))
    return R.stuffed_prompt(hits, rows.select(F.col("item_id").alias("q"), F.col("text").alias("question")), "Context:\n{context}")


# --- chunking -----------------------------------------------------------------------------------


def chunk_fixed(spark, sf_dir):
    return C.fixed_chunks(documents(spark, sf_dir), SIZE, OVERLAP).select("doc_id", "chunk_idx", "start", "text")


def chunk_soft_boundary(spark, sf_dir):
    return C.sliding_chunks(documents(spark, sf_dir), C.ChunkSettings(SIZE, OVERLAP))


def chunk_lateral(spark, sf_dir):
    """``chunk_soft_boundary`` by a lateral join with the table function."""
    tables.register(spark)
    return spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL chunk(d.text, {SIZE}, {OVERLAP}) c", docs=documents(spark, sf_dir))


def chunk_recursive(spark, sf_dir):
    return C.recursive_chunks(documents(spark, sf_dir), SIZE, OVERLAP)


def layout_segments(spark, sf_dir):
    return B.with_offsets(B.segments(derived_blocks(spark, sf_dir)))


def layout_texts(spark, sf_dir):
    return B.full_text(layout_segments(spark, sf_dir))


def sticky_header(spark, sf_dir):
    return layout_segments(spark, sf_dir).select("doc_id", "block_idx", "header", "prefix")


def segment_offsets(spark, sf_dir):
    return layout_segments(spark, sf_dir).select("doc_id", "block_idx", "seg_start", "seg_end", "is_special")


def block_texts(spark, sf_dir):
    return B.kept(derived_blocks(spark, sf_dir)).select("doc_id", "block_idx", "type", T.normalize_text(B.block_text()).alias("text"), B.caption().alias("caption"))


def item_texts(spark, sf_dir):
    return B.packing_segments(derived_blocks(spark, sf_dir), "base").select("doc_id", "block_idx", "text", F.get(F.col("images.path"), F.lit(0)).alias("image"))


def chunk_atomic(spark, sf_dir):
    return C.sliding_chunks(layout_texts(spark, sf_dir), C.ChunkSettings(SIZE, OVERLAP), text_col="full_text", spans_col="spans").select("doc_id", "chunk_idx", "start", "end")


def special_chunks(spark, sf_dir):
    return C.special_chunks(layout_texts(spark, sf_dir), C.ChunkSettings(SIZE, OVERLAP)).select("doc_id", "block_idx", "special_type", "start", "end")


def layout_chunks(spark, sf_dir):
    rows = C.layout_chunks(derived_blocks(spark, sf_dir), C.ChunkSettings(SIZE, OVERLAP), "pdf")
    lists = [F.array_join(c, "|").alias(n) for n, c in (("headers", F.col("headers")), ("special_types", F.col("special_types")), ("pages", F.array_sort(F.map_keys("page_spans"))))]
    return rows.select("doc_id", "chunk_idx", "text", "is_special", "special_type", *lists)


def chunk_segment_overlap(spark, sf_dir):
    segments = scratch.stored(layout_segments(spark, sf_dir))
    chunks = C.sliding_chunks(B.full_text(segments), C.ChunkSettings(SIZE, OVERLAP), text_col="full_text", spans_col="spans")
    c, s = chunks.alias("c"), segments.alias("s")
    met = c.join(s, (F.col("c.doc_id") == F.col("s.doc_id")) & (F.col("s.seg_end") > F.col("c.start")) & (F.col("s.seg_start") < F.col("c.end")))
    start = F.col("c.start")
    rows = met.select(F.col("c.doc_id").alias("doc_id"), "chunk_idx", "page_idx", (F.greatest("seg_start", start) - start).alias("a"), (F.least("seg_end", F.col("c.end")) - start).alias("b"))
    return rows.groupBy("doc_id", "chunk_idx", "page_idx").agg(F.min("a").alias("page_from"), F.max("b").alias("page_to"))


def chunk_segment_bins(spark, sf_dir):
    """``chunk_segment_overlap`` with spans dealt into bins, so that one document is many tasks."""
    segments = scratch.stored(layout_segments(spark, sf_dir))
    chunks = C.sliding_chunks(B.full_text(segments), C.ChunkSettings(SIZE, OVERLAP), text_col="full_text", spans_col="spans").select("doc_id", "chunk_idx", "start", "end")
    met = ranges.overlaps(chunks, segments.select("doc_id", "page_idx", "seg_start", "seg_end"), ["doc_id"], ("start", "end"), ("seg_start", "seg_end"))
    rows = met.select("doc_id", "chunk_idx", "page_idx", (F.greatest("seg_start", "start") - F.col("start")).alias("a"), (F.least("seg_end", "end") - F.col("start")).alias("b"))
    return rows.groupBy("doc_id", "chunk_idx", "page_idx").agg(F.min("a").alias("page_from"), F.max("b").alias("page_to"))


def neighbor_context(spark, sf_dir):
    return B.neighbour_context(derived_blocks(spark, sf_dir), 250).select("doc_id", "block_idx", "left", "right")


def page_bbox_union(spark, sf_dir):
    rows = B.page_boxes(B.packing_segments(derived_blocks(spark, sf_dir)), "doc_id")
    return rows.select("doc_id", "page_idx", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def bbox_normalize(spark, sf_dir):
    rows = derived_blocks(spark, sf_dir).select("doc_id", "block_idx", T.normalize_bbox(F.col("bbox"), F.lit(612), F.lit(792)).alias("b"))
    return rows.select("doc_id", "block_idx", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def pack_segments(spark, sf_dir):
    rows = C.pack_segments(B.packing_segments(derived_blocks(spark, sf_dir), "base"), 600, 120)
    return rows.select("doc_id", "chunk_idx", "pos", "block_idx", "text")


def packed_documents(spark, sf_dir):
    source = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("/src/"), F.col("source"), F.lit(".pdf")).alias("source_path"))
    rows = C.packed_documents(derived_blocks(spark, sf_dir), source, 600, 120, "base")
    return rows.select("doc_id", "chunk_idx", "page_content", "source_file", "page_start", "page_end", F.array_join("image_paths", "|").alias("image_paths"))


# --- chat history -------------------------------------------------------------------------------


def chat_turn_pairs(spark, sf_dir):
    return H.turns_of(read(spark, sf_dir, "conversations"))


def chat_last_n(spark, sf_dir):
    return H.last_turns(chat_turn_pairs(spark, sf_dir), 2)


def chat_messages(spark, sf_dir):
    return H.messages_of(chat_last_n(spark, sf_dir))


def chat_turn_count(spark, sf_dir):
    return H.turn_count(H.messages_of(chat_turn_pairs(spark, sf_dir)))


# --- evaluation ---------------------------------------------------------------------------------


def results(spark, sf_dir):
    rows = read(spark, sf_dir, "labels")
    two = F.array(F.struct(F.lit("quality").alias("name"), F.col("quality").alias("v")), F.struct(F.lit("toxic").alias("name"), F.col("toxic").alias("v")))
    rows = rows.select("doc_id", F.inline(two))
    score = F.when(F.pmod("doc_id", F.lit(9)) != 0, F.col("v").cast("double") * 0.75)
    return rows.select(F.col("doc_id").alias("row_id"), "name", score.alias("score"), F.lit(E.THRESHOLD).alias("threshold"), (F.coalesce(score, F.lit(0.0)) >= E.THRESHOLD).alias("success"))


def metric_summary(spark, sf_dir):
    return E.summary(results(spark, sf_dir))


def metric_rollup(spark, sf_dir):
    """The metrics by name, by name and source, and by name and language, in one aggregation."""
    rows = results(spark, sf_dir).join(documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "source", "lang"), "row_id")
    return E.rollup(rows, [["name"], ["name", "source"], ["name", "lang"]])


def row_id_then_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.when(F.pmod("item_id", F.lit(4)) != 0, F.col("text")).otherwise("  ").alias("question"))
    return E.numbered(rows, "item_id")


def eval_dataset_validate(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.left("text", F.lit(60)).alias("ground_truth"))
    return E.validated_dataset(rows)


def verdicts(spark, sf_dir):
    return read(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 10).cast("long").alias("case_id"), "doc_id", "quality")


def contextual_precision(spark, sf_dir):
    return E.contextual_precision(verdicts(spark, sf_dir), "case_id", "doc_id", "quality").select("case_id", F.round("score", 6).alias("score"))


def answer_relevancy_ratio(spark, sf_dir):
    return verdicts(spark, sf_dir).groupBy("case_id").agg(F.round(E.share_of(F.col("quality") == 1), 6).alias("score"))


def failed_result_padding(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("reason", F.lit("judged"))
    cases = documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"))
    return E.padded(cases, rows)


# --- ingest state -------------------------------------------------------------------------------


def sources_of(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.lit("markdown").alias("source_type"), F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))


def state_log(spark, sf_dir):
    made = sources_of(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").withColumn("key", T.source_key(F.col("source_type"), F.col("path")))
    first = made.select("key", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("chunks"), F.lit("parse error").alias("error"), F.lit("2024-01-01T00:00:00").alias("updated_at"))
    later = made.where("quality = 1").select("key", F.lit("done").alias("status"), F.col("doc_id").alias("chunks"), F.lit("").alias("error"), F.lit("2024-01-02T00:00:00").alias("updated_at"))
    return first.unionByName(later)


def checkpoint_latest(spark, sf_dir):
    return I.latest_state(state_log(spark, sf_dir))


def state_as_of(spark, sf_dir):
    """Each labelled document's state at a time of its own, from the log."""
    log = state_log(spark, sf_dir).select("key", "status", "updated_at")
    asked = sources_of(spark, sf_dir).select("doc_id", T.source_key(F.col("source_type"), F.col("path")).alias("key"), F.concat(F.lit("2024-01-0"), F.pmod("doc_id", F.lit(3)).cast("string"), F.lit("T12:00:00")).alias("asked_at"))
    return ranges.as_of(asked, log, ["key"], "asked_at", "updated_at", ["status", "updated_at"]).select("doc_id", "asked_at", "status", "updated_at")


def ingest_pending(spark, sf_dir):
    return I.pending(sources_of(spark, sf_dir), checkpoint_latest(spark, sf_dir)).select("doc_id", "key")


def failure_isolation_counts(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.when(F.pmod("doc_id", F.lit(13)) == 0, "failed").when(F.pmod("doc_id", F.lit(5)) == 0, "skipped").otherwise("done").alias("status"))
    return I.counters(rows)
