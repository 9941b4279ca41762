"""The three jobs: build the index, answer questions, evaluate answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import blocks, chunking, evaluation, history, ingest, models, retrieval
from .sources import files, paged, sinks

SYSTEM = "Answer from the context only.\n\n{context}"


def prepare_index(spark: SparkSession, s: Settings, embedder: models.Model, parser: Callable | None = None, describer: models.Model | None = None, force: bool = False, checkpoint: bool = False, pages: tuple[int, int | None] = (0, None), side_dir: str | None = None, packing: bool = False, keyed: bool = False) -> dict[str, int]:
    """Parses, chunks, embeds and appends all pending sources in one job; counts by status. Raises at the end if a source failed.

    With ``keyed`` the rows of a source take the place of those that the index has of it, so that doing it again changes
    nothing; a source that fails keeps what it has.

    A parser that has ``count`` and ``parse`` (``sources.paged``) reads large files by pages in many tasks; a function takes
    a file whole. Only pending files are parsed, and they are chunked by layout, or with ``packing`` by packing whole blocks.
    Chunks are numbered by run, source and place, so that equal scores go by the order of ingestion.
    """
    sources = files.list_sources(spark, s.pdf_dir if parser else None, s.markdown_dir)
    state = ingest.latest_state(files.read_state(spark, s.checkpoint_dir)) if checkpoint else spark.createDataFrame([], ingest.STATE)
    todo = ingest.pending(sources, state, force or not checkpoint)
    skipped = sources.count() - todo.count()
    parts, failed = [], None
    if ingest.has_data(spark, s.markdown_dir):
        texts = files.read_texts(spark, s.markdown_dir).join(todo.select(F.col("path").alias("source")), "source", "left_semi")
        parts.append(chunking.recursive_chunks(texts, s.chunk_size, s.chunk_overlap, id_col="source").select("source", "chunk_idx", F.col("text").alias("page_content"), F.lit(None).cast("string").alias("metadata")))
    if parser and ingest.has_data(spark, s.pdf_dir):
        wanted = todo.where("source_type = 'pdf'").select("path")
        if hasattr(parser, "parse"):
            parsed = paged.read_pages(spark, s.pdf_dir, parser, pages, frozenset(r.path for r in wanted.toLocalIterator())).persist()
            failed, rows = paged.failures(parsed), paged.blocks_of(parsed)
        else:
            parsed = files.parse_files(spark, s.pdf_dir, parser, pages, wanted).persist()
            failed, rows = parsed.where("error IS NOT NULL").select("source", "error"), files.blocks_of(parsed)
        if side_dir:
            sinks.write_parsed(parsed, side_dir)
        rows = blocks.describe_special(rows.drop("source"), describer).join(rows.select("doc_id", "source").distinct(), "doc_id") if describer else rows
        named = rows.select("doc_id", "source").distinct()
        if packing:
            packs = chunking.packed_documents(rows.drop("source"), named.withColumnRenamed("source", "source_path"), s.chunk_size, s.chunk_overlap, side_dir or "")
            facts = ("source_file", "page_idxs", "page_start", "page_end", "page_spans", "image_paths", "image_paths_rel", "images")
            parts.append(packs.select("source", "chunk_idx", "page_content", F.to_json(F.struct(*facts)).alias("metadata")))
        else:
            chunks = chunking.layout_chunks(rows.drop("source"), chunking.ChunkSettings(s.chunk_size, s.chunk_overlap), "pdf").join(named, "doc_id")
            facts = ("page_spans", "bbox", "headers", "is_special", "special_type", "special_focus", "doc_format")
            parts.append(chunks.select("source", "chunk_idx", F.col("text").alias("page_content"), F.to_json(F.struct(*facts)).alias("metadata")))
    if force:
        sinks.clear_index(spark, s.index_dir)
    if parts:
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        placed = ingest.indexed(ingest.positioned(every, todo, files.read_index(spark, s.index_dir), keep=keyed), embedder)
        done = todo.select(F.col("path").alias("source"))
        done = done.join(failed.select("source"), "source", "left_anti") if failed is not None else done
        if keyed:
            sinks.upsert_index(placed, done, s.index_dir, batch=s.add_batch_size)
        else:
            sinks.write_index(placed, s.index_dir, batch=s.add_batch_size)
    written = files.read_index(spark, s.index_dir)
    counted = written.groupBy("source").agg(F.count("*").alias("chunks")) if written is not None else spark.createDataFrame([], "source string, chunks long")
    failed = failed if failed is not None else spark.createDataFrame([], "source string, error string")
    outcome = todo.withColumnRenamed("path", "source").join(counted, "source", "left").join(failed, "source", "left").select("key", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "error")
    if checkpoint:
        sinks.append_state(outcome, s.checkpoint_dir)
    counts = {r.status: r.n for r in ingest.counters(outcome).collect()}
    if counts.get("failed"):
        raise RuntimeError(f"{counts['failed']} sources failed")
    return {"processed": counts.get("done", 0), "skipped": skipped, "failed": 0}


def answer(spark: SparkSession, s: Settings, questions: DataFrame, embedder: models.Model, model: models.Model, system: str = SYSTEM, past: DataFrame | None = None) -> DataFrame:
    """(q, question, prompt, answer, contexts) for a set (q, question); ``past`` has messages (q, seq, role, content) that go before the question."""
    index = files.read_index(spark, s.index_dir)
    if index is None:
        raise evaluation.PreconditionError("there is no index; build it first")
    docs = index.select(F.col("position").alias("doc_id"), "source", F.col("page_content").alias("text"), "embedding")
    asked = questions.select("q", embedder.column(F.col("question"), fail=True).alias("v")).persist()  # a question is embedded once
    retrieve = retrieval.build_retriever(docs, docs.select("doc_id", "embedding"), s.retriever_mode, s.top_k, s.hybrid_sparse_k, (s.hybrid_dense_weight, s.hybrid_sparse_weight), s.hybrid_rrf_k, s.mmr_fetch_k, s.mmr_lambda)
    hits = retrieve(questions.select(F.col("q").alias("item_id"), F.col("question").alias("text")), asked).join(docs.select("doc_id", "text"), "doc_id")
    prompts = retrieval.stuffed_prompt(hits, questions, system)
    if past is not None:
        said = past.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("said"))
        prompts = prompts.join(said, "q", "left").withColumn("prompt", F.concat_ws("\n\n", "said", "prompt")).drop("said")
    contexts = hits.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    return questions.join(prompts, "q").join(contexts, "q", "left").withColumn("answer", model.column(F.col("prompt"), on_error=""))


def chat(spark: SparkSession, s: Settings, session: str, question: str, embedder: models.Model, model: models.Model, stateless: bool = False) -> str:
    """One question in a session: its last turns go before it, and the turn is appended."""
    row = spark.createDataFrame([(0, question)], "q long, question string")
    past = None
    if s.conversational and not stateless:
        turns = files.read_turns(spark, s.history_dir, session).select(F.lit(0).cast("long").alias("q"), F.col("ts_utc").alias("turn"), "user", "assistant")
        past = history.messages_of(history.last_turns(turns, s.chat_history_max_turns, "q"), "q")
    said = answer(spark, s, row, embedder, model, past=past).first().answer
    if not stateless:
        sinks.append_turns(spark.createDataFrame([(session, question, said)], "session string, user string, assistant string"), s.history_dir)
    return said


def evaluate(spark: SparkSession, s: Settings, dataset: str, embedder: models.Model, model: models.Model, judge: Callable[[DataFrame], DataFrame], max_rows: int | None = None, max_contexts: int = 2, max_chars: int = 1400, prefix: str = "") -> dict[str, str]:
    """Answers a dataset, judges the cases by an injected function to (row_id, name, score, threshold, success, reason), and writes the results."""
    rows = evaluation.numbered(files.read_dataset(spark, dataset), "line", limit=max_rows).drop("answer", "contexts")
    said = answer(spark, s, rows.select(F.col("row_id").alias("q"), "question"), embedder, model)
    records = rows.join(said.select(F.col("q").alias("row_id"), "answer", retrieval.prepare_contexts(F.col("contexts"), max(1, max_contexts), max(100, max_chars)).alias("contexts")), "row_id")
    if records.isEmpty():
        raise evaluation.PreconditionError("nothing was answered")
    results = evaluation.padded(evaluation.test_cases(records).select("row_id"), judge(evaluation.test_cases(records)))
    return sinks.write_evaluation(records, evaluation.summary(results), evaluation.detailed(records, results), s.eval_dir, prefix)
