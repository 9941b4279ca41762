"""Command line: ``python -m lectern.cli index|ask|evaluate``."""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import engine
from .config import Settings, parse_think, request_timeout
from .functions.text import session_id
from .operators import evaluation, judging, models
from .sources import sinks

log = logging.getLogger("lectern")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--server", help="address of a chat server; stub models without it")
    p.add_argument("--embed-model", default="stub")
    p.add_argument("--concurrency", type=int, default=1, help="calls of the server that a task has open at a time")
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("index", help="build the index from the source folders")
    a.add_argument("--force", action="store_true", help="replace the index and take all sources again")
    a.add_argument("--keyed", action="store_true", help="replace what the index has of a source instead of adding to it")
    a.add_argument("--checkpoint", action="store_true", help="skip sources that the log has as done")
    a.add_argument("--checkpoint-file", help="where the log is, if not in the folder of the settings")
    a.add_argument("--parser", help="package.module:function that turns a PDF's path and bytes into layout blocks; without it only texts are taken")
    a.add_argument("--pages", type=pages, default=(0, None), help="first:last page of each PDF, from 0")
    a.add_argument("--dump-blocks", help="folder for the parser's blocks")
    a.add_argument("--packing", action="store_true", help="pack whole blocks of a PDF instead of cutting its text")
    a.add_argument("--describe", action="store_true", help="have the model describe tables, images and equations")
    a = sub.add_parser("ask", help="answer a question")
    a.add_argument("question")
    a.add_argument("--session-id")
    a.add_argument("--max-history-turns", type=int)
    a.add_argument("--stateless", action="store_true")
    a.add_argument("--clear-history", action="store_true")
    a = sub.add_parser("evaluate", help="answer and judge a dataset")
    a.add_argument("--dataset", required=True)
    a.add_argument("--max-rows", type=int)
    a.add_argument("--max-contexts", type=int, default=2)
    a.add_argument("--max-context-chars", type=int, default=1400)
    a.add_argument("--output-prefix", default="")
    a.add_argument("--eval-batch-size", type=int, default=1, help="prompts in one call of the judge")
    a.add_argument("--judge-timeout-seconds", type=int, default=300, help="for one answer of the judge, 30 at least; 0 or less: none")
    errors = a.add_mutually_exclusive_group()
    errors.add_argument("--ignore-eval-errors", dest="fail", action="store_false", help="a case that cannot be judged is a failure (the default)")
    errors.add_argument("--fail-on-eval-error", dest="fail", action="store_true")
    a.set_defaults(fail=False)
    return p


def pages(text: str) -> tuple[int, int | None]:
    first, _, last = text.partition(":")
    return int(first or 0), int(last) if last else None


def loaded(name: str | None):
    """The function that a name of the form package.module:function stands for."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, settings: Settings | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    s = settings or Settings()
    embedder, model, judge = models.stub_embedding(256), models.stub(), models.stub_judge()
    if args.server:
        from .operators import http

        embedder = http.embedding_model(http.Server(args.server, args.embed_model, request_timeout(s)), s.embed_batch_size)
        server = http.Server(args.server, s.model_name, request_timeout(s), (("temperature", s.temperature), ("num_predict", s.num_predict)))
        # a server that is short of memory answers 503: the embedding model makes room
        retry = models.Retry(release=http.Server(args.server, args.embed_model).release)
        think = parse_think(s.think, s.model_name)
        model = http.concurrent_chat_model(server, retry, think, args.concurrency) if args.concurrency > 1 else http.chat_model(server, retry, think)
        if args.job == "evaluate":
            seconds = max(30, args.judge_timeout_seconds) if args.judge_timeout_seconds > 0 else None
            how = (http.Server(args.server, s.judge_name, seconds), judging.SCHEMA, s.judge_retries, s.judge_num_predict)
            if args.concurrency > 1:
                judge = http.concurrent_judge(*how, concurrency=args.concurrency, think=parse_think(s.think, s.judge_name))
            else:
                ask = http.judge(*how, think=parse_think(s.think, s.judge_name))
                judge = models.Model(lambda prompts: [ask(p) for p in prompts], max(1, args.eval_batch_size))
    try:
        if args.job == "index":
            if args.checkpoint_file:
                s = Settings(**{**vars(s), "checkpoint_dir": args.checkpoint_file})
            print(json.dumps(engine.prepare_index(spark, s, embedder, loaded(args.parser), model if args.describe else None, args.force, args.checkpoint, args.pages, args.dump_blocks, args.packing, args.keyed)))
        elif args.job == "ask":
            if args.max_history_turns is not None:
                s = Settings(**{**vars(s), "chat_history_max_turns": args.max_history_turns})
            session = spark.range(1).select(session_id(F.lit(args.session_id or s.chat_session_id)).alias("v")).first().v
            if args.clear_history:
                sinks.clear_session(spark, s.history_dir, session)
            print(engine.chat(spark, s, session, args.question, embedder, model, args.stateless))
        else:
            print(json.dumps(engine.evaluate(spark, s, args.dataset, embedder, model, lambda cases: judging.judged(cases, judge, fail=args.fail), args.max_rows, args.max_contexts, args.max_context_chars, args.output_prefix)))
    except (evaluation.PreconditionError, RuntimeError, ValueError) as e:
        print(json.dumps({"error": f"{type(e).__name__}: {e}"}, ensure_ascii=False))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
