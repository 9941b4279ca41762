"""Streams, keyed writes and concurrent calls."""

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lectern import engine
from lectern.config import Settings
from lectern.operators import history, http, models
from lectern.sources import files, sinks
from lectern.streaming import turns

from .conftest import SF

SHAPE = "conv_id long, turn long, role string, text string, at timestamp"


def streamed(spark, batches, where, **options):
    """The turns of a stream that takes one batch of rows after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(f"{where}/in/batch={i:03}")
        time.sleep(0.01)
    source = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{where}/in")
    found = turns.turn_stream(source, **options)
    query = found.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])
    return sorted((r.conv_id, r.turn, r.user, r.assistant) for r in spark.read.schema("conv_id long, turn long, user string, assistant string").parquet(f"{where}/out").collect()), dropped


@pytest.fixture
def stamped(spark):
    messages = spark.read.parquet(f"{SF}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return messages.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60 + F.col("conv_id") % 50))


def end(spark, day):
    """A message of a conversation of its own, so much later that all before it is settled."""
    at = spark.range(1).select(F.timestamp_seconds(F.lit(1_700_000_000 + day * 86_400)).alias("t")).first().t
    return [(-1, day, "assistant", "end", at)]


def test_shuffled_stream_gives_the_turns(spark, stamped, tmp_path):
    rows = [tuple(r) for r in stamped.collect()]
    random.Random(4).shuffle(rows)
    batches = [rows[i::5] for i in range(5)] + [end(spark, 30), end(spark, 31)]
    got, dropped = streamed(spark, batches, str(tmp_path), delay="2 days", gap_seconds=3600)
    want = sorted((r.conv_id, r.turn, r.user, r.assistant) for r in history.turns_of(stamped).collect())
    assert got == want and not dropped


def test_late_messages_are_dropped(spark, stamped, tmp_path):
    rows = sorted((tuple(r) for r in stamped.where("conv_id < 6").collect()), key=lambda r: r[4])
    late = [(77, 1, "user", "too late", rows[0][4])]
    got, dropped = streamed(spark, [rows, end(spark, 10), end(spark, 11), late, end(spark, 12)], str(tmp_path), delay="1 minute", gap_seconds=60)
    want = sorted((r.conv_id, r.turn, r.user, r.assistant) for r in history.turns_of(stamped.where("conv_id < 6")).collect())
    assert got == want and dropped == 1


def test_settled():
    said = [(1, 1, "user", "a"), (2, 2, "assistant", "b"), (3, 3, "user", "c"), (9, 4, "user", "d")]
    assert turns.settled(said, 2, 5) == ([(1, "a", "b")], said[2:], 3)
    assert turns.settled(said, 3, 5) == ([(1, "a", "b")], said[2:], 9)
    assert turns.settled(said, 13, 5) == ([(1, "a", "b"), (3, "c", "")], said[3:], 14)
    assert turns.settled(said, 14, 5) == ([(1, "a", "b"), (3, "c", ""), (4, "d", "")], [], None)
    assert turns.settled([], 5, 5) == ([], [], None)


# --- keyed writes ---------------------------------------------------------------------------------


def test_ingesting_twice_leaves_one_copy(spark, tmp_path):
    docs = tmp_path / "md"
    docs.mkdir()
    for i in range(6):
        (docs / f"d{i}.md").write_text(f"document {i} " + "some words. " * (100 * i))
    s = Settings(markdown_dir=str(docs), pdf_dir=str(tmp_path / "no"), index_dir=str(tmp_path / "index"), checkpoint_dir=str(tmp_path / "state"))
    every = lambda: sorted((r.source, r.position, r.page_content) for r in files.read_index(spark, s.index_dir).collect())
    embedder = models.stub_embedding()
    engine.prepare_index(spark, s, embedder, keyed=True)
    first = every()
    engine.prepare_index(spark, s, embedder, keyed=True)
    assert every() == first and len(first) > 6
    # a file that changes, one that goes blank, and one that comes
    (docs / "d1.md").write_text("changed")
    (docs / "d2.md").write_text(" \n \n")
    (docs / "d9.md").write_text("new")
    engine.prepare_index(spark, s, embedder, keyed=True)
    got = every()
    named = lambda rows, *ends: [r for r in rows if r[0].endswith(ends)]
    assert [r[2] for r in named(got, "d1.md", "d9.md")] == ["changed", "new"] and not named(got, "d2.md")
    rest = ("d0.md", "d3.md", "d4.md", "d5.md")
    assert named(got, *rest) == named(first, *rest)
    assert len({r[1] for r in got}) == len(got) and named(got, "d9.md")[0][1] > max(r[1] for r in first)


def test_only_touched_folders_are_written(spark, tmp_path):
    where = str(tmp_path / "index")
    made = lambda names, text: spark.createDataFrame([(n, i, text) for n in names for i in range(3)], "source string, position long, page_content string")
    names = [f"s{i}" for i in range(40)]
    of = lambda names: spark.createDataFrame([(n,) for n in names], "source string")
    sinks.upsert_index(made(names, "old"), of(names), where)
    files_of = lambda: {p.relative_to(tmp_path) for p in tmp_path.rglob("*.parquet")}
    before = files_of()
    sinks.upsert_index(made(["s3"], "new"), of(["s3"]), where)
    changed = {p.parent for p in before ^ files_of()}
    assert len(changed) == 1
    rows = files.read_index(spark, where).collect()
    assert len(rows) == 120 and {r.page_content for r in rows if r.source == "s3"} == {"new"} and sum(r.page_content == "old" for r in rows) == 117
    sinks.upsert_index(made([], "none").limit(0), of(names), where)
    assert files.read_index(spark, where) is None


# --- concurrent calls -------------------------------------------------------------------------------


@pytest.fixture
def slow():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][0]["content"]
            time.sleep(3 if said == "hang" else 0.1)
            data = json.dumps({"message": {"content": f"hi {said}"}}).encode()
            self.send_response(500 if said == "fail" else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            try:
                self.wfile.write(data)
            except OSError:
                pass

        def log_message(self, *args):
            pass

    class Server(ThreadingHTTPServer):
        request_queue_size = 128

    httpd = Server(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def test_calls_in_flight(slow):
    prompts = [str(i) for i in range(64)]
    took = {}
    for n in (4, 16):
        began = time.perf_counter()
        assert http.concurrent_chat_model(http.Server(slow, "m", 5), concurrency=n).answers(prompts) == [f"hi {p}" for p in prompts]
        took[n] = time.perf_counter() - began
    assert took[16] < 0.4 * took[4], took


def test_failures_of_calls_in_flight(spark, slow):
    model = http.concurrent_chat_model(http.Server(slow, "m", 5), models.Retry(attempts=1), concurrency=8, timeout=1.0)
    prompts = ["a", "fail", "b", "hang", "c"]
    assert model.answers(prompts, on_error="-") == ["hi a", "-", "hi b", "-", "hi c"]
    with pytest.raises(RuntimeError):
        model.answers(["a", "fail"], fail=True)
    rows = spark.createDataFrame([(p,) for p in prompts[:3]], "t string").coalesce(1)
    assert [r.v for r in rows.select(model.column(F.col("t"), on_error="-").alias("v")).collect()] == ["hi a", "-", "hi b"]
