import asyncio
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.config import Settings
from lectern.operators import http, retrieval
from lectern.operators.models import Retry


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            if self.path == "/api/embed":
                reply, status = {"embeddings": [[float(len(t)), 1.0] for t in body["input"]]}, 200
            elif len(seen) == 1 and body["model"] == "busy":
                reply, status = {"error": "busy"}, 503
            elif body.get("format"):
                reply, status = {"message": {"content": "" if "num_predict" not in body["options"] else 'x {"a": 1}'}}, 200
            else:
                reply, status = {"message": {"content": "hi " + body["messages"][0]["content"]}}, 200
            data = json.dumps(reply).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", seen
    httpd.shutdown()


def test_models_over_http(spark, server):
    url, seen = server
    busy = http.chat_model(http.Server(url, "busy", 5), Retry(wait=0))
    rows = spark.createDataFrame([("there",)], "t string").coalesce(1)
    assert rows.select(busy.column(F.col("t"), fail=True).alias("v")).first().v == "hi there"
    assert seen[0][1]["stream"] is False
    embed = http.embedding_model(http.Server(url, "e", 5))
    assert rows.select(embed.column(F.col("t"), fail=True).alias("v")).first().v == [5.0, 1.0]
    assert http.judge(http.Server(url, "j", 5), {"type": "object"})("p") == '{"a":1}'
    assert asyncio.run(http.judge_async(http.Server(url, "j", 5), {"type": "object"})("p")) == '{"a":1}'
    assert asyncio.run(http.Server(url, "plain", 5).ask_async("you")) == "hi you"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("alpha beta gamma. " * 20)
    s = Settings(markdown_dir=str(tmp_path / "md"), pdf_dir=str(tmp_path / "no"), index_dir=str(tmp_path / "index"), checkpoint_dir=str(tmp_path / "state"), history_dir=str(tmp_path / "chat"), eval_dir=str(tmp_path / "eval"))
    assert cli.main(["ask", "alpha"], spark, s) == 1
    assert "error" in json.loads(capsys.readouterr().out)
    assert cli.main(["index", "--force"], spark, s) == 0
    assert json.loads(capsys.readouterr().out)["processed"] == 1
    assert cli.main(["ask", "alpha", "--session-id", "a b"], spark, s) == 0
    assert capsys.readouterr().out.startswith("answer")
    data = tmp_path / "set.json"
    data.write_text(json.dumps([{"question": "alpha?", "ground_truth": "beta"}]))
    assert cli.main(["evaluate", "--dataset", str(data), "--output-prefix", "run"], spark, s) == 0
    paths = json.loads(capsys.readouterr().out)
    assert {r.name for r in spark.read.json(paths["summary"]).collect()} == {"Answer Relevancy", "Faithfulness", "Contextual Precision"}
    assert all(m.reason != "no result" for m in spark.read.json(paths["detailed"]).first().metrics)


def test_command_line_options():
    args = cli.parser().parse_args(["evaluate", "--dataset", "x"])
    assert (args.max_contexts, args.max_context_chars, args.eval_batch_size, args.judge_timeout_seconds, args.fail) == (2, 1400, 1, 300, False)
    assert cli.parser().parse_args(["evaluate", "--dataset", "x", "--fail-on-eval-error"]).fail
    args = cli.parser().parse_args(["index", "--pages", "2:5", "--parser", "json:loads", "--checkpoint-file", "f"])
    assert args.pages == (2, 5) and cli.pages("3:") == (3, None) and cli.loaded(args.parser) is json.loads and args.checkpoint_file == "f"


def test_source_text(spark):
    rows = spark.createDataFrame([('{"page_content": "a"}',), ('{"text": "b"}',), ('"c"',), ("3",)], "r string")
    assert [r.v for r in rows.select(retrieval.source_text(F.col("r"), True).alias("v")).collect()] == ["a", "b", "c", None]
