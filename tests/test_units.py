"""Small worked cases for rules that decide results."""

import json
import math
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern import config
from lectern.functions import jsonfix
from lectern.functions import text as T
from lectern.operators import blocks as B
from lectern.operators import chunking as C
from lectern.operators import evaluation as E
from lectern.operators import history as H
from lectern.operators import ingest as I
from lectern.operators import judging as J
from lectern.operators import models as M
from lectern.operators import retrieval as R


def values(spark, column, *args):
    return spark.range(1).select(column(*[F.lit(a) for a in args]).alias("v")).first().v


def filler(n, marks):
    text = ["x"] * n
    for i, c in marks.items():
        text[i] = c
    return "".join(text)


def test_soft_cut_takes_the_first_sentence_end():
    text = filler(200, {61: ".", 62: " ", 94: ".", 95: " ", 107: ".", 108: " "})
    assert C.soft_cut(text, 0, 100, 40) == 62


@pytest.mark.parametrize(("place", "cut"), [(110, 110), (111, 91)])
def test_soft_cut_goes_ten_beyond_at_most(place, cut):
    text = filler(200, {place - 1: ".", place: " ", 70: " ", 90: " "})
    assert C.soft_cut(text, 0, 100, 40) == cut


def test_soft_cut_without_a_gap_is_hard():
    assert C.soft_cut("x" * 200, 0, 100, 40) == 100
    assert C.soft_cut("x" * 50, 0, 100, 40) == 100


def test_atomic_cut():
    assert C.atomic_cut(0, 100, [(90, 150)], 100) == 150
    assert C.atomic_cut(0, 1000, [(900, 1600)], 1000) == 900
    assert C.atomic_cut(0, 1000, [(150, 1700)], 1000) == 1000


@given(st.text(alphabet="ab .!\n", max_size=400), st.integers(5, 60), st.integers(0, 70))
def test_chunks_cover_all_but_blanks(text, size, overlap):
    spans = C.cuts(text, [], C.ChunkSettings(size, overlap, window=4))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert all(0 < b - a <= size + 10 for a, b in spans)
    assert [a for a, _ in spans] == sorted(a for a, _ in spans)


def test_chunk_settings_are_checked():
    assert C.ChunkSettings(10, 50).overlap == 9
    for bad in ((0, 0), (10, -1)):
        with pytest.raises(ValueError):
            C.ChunkSettings(*bad)


def test_packing_keeps_the_joiner_cost():
    assert C.pack_sizes([6, 4, 3], 10, 0) == [[0], [1], [2]]
    assert C.pack_sizes([4, 4, 0, 4], 10, 5) == [[0, 1, 2], [1, 3]]
    assert C.pack_sizes([], 10, 5) == []
    assert C.pack_sizes([5, 5], 0, 5) == [[0, 1]]


def test_hard_split():
    assert C.hard_split("aa bb cc", 5) == ["aa", "bb", "cc"]
    assert C.hard_split("a" * 12, 5) == ["aaaaa", "aaaaa", "aa"]
    assert C.hard_split("ab", 5) == ["ab"]


@given(st.text(alphabet="ab \n", max_size=300), st.integers(4, 50), st.integers(0, 3))
def test_recursive_split_pieces_are_short_and_in_the_text(text, size, overlap):
    pieces = C.recursive_split(text, size, overlap)
    assert all(p == p.strip() and p and len(p) <= size and p in text for p in pieces)
    assert "".join("".join(pieces).split()).count("a") >= text.count("a")


def test_text_functions(spark):
    assert values(spark, T.normalize_text, " a­b \u00a0\x1c c ") == "ab c"
    assert values(spark, T.strip_html, "<td>a</td><td>b</td>") == "a b"
    assert [values(spark, T.session_id, x) for x in ("a b/ü:c", "", "///")] == ["a_b_c", "default", "_"]
    assert values(spark, T.preview, "a\r\n" + "b" * 900).endswith("b...<truncated>")
    box = T.normalize_bbox(F.array(*map(F.lit, (10, 20, 30, 40))), F.lit(200), F.lit(400))
    assert spark.range(1).select(box.alias("b")).first().b == [50, 50, 150, 100]
    assert spark.range(1).select(T.normalize_bbox(F.array(F.lit(1)), F.lit(0), F.lit(4)).alias("b")).first().b == [1]


def test_weights():
    assert T.normalize_weights(0, 0) == (0.5, 0.5)
    assert T.normalize_weights(-1, 2) == (0, 1)


def test_json_repair():
    assert jsonfix.fix_escapes(r'{"a": "x\qy\n\u00e9"}') == r'{"a": "x\\qy\n\u00e9"}'
    assert jsonfix.fix_escapes("\\q outside") == "\\q outside"
    assert jsonfix.find_json('```json\n{"a":1}\n```') == '{"a":1}'
    assert jsonfix.find_json('so: {"a":1} and') == '{"a": 1}'
    assert jsonfix.recover('text {"p": "C:\\dir"} end') is None or json.loads(jsonfix.recover('{"p": "C:\\dir"}'))["p"] == "C:\\dir"
    assert jsonfix.recover("nothing") is None


@given(st.dictionaries(st.text(max_size=5), st.text(max_size=8), max_size=4))
def test_json_round_trip(value):
    assert json.loads(jsonfix.recover("x " + json.dumps(value) + " y")) == value


def test_rrf_order(spark):
    rows = lambda names: spark.createDataFrame([(0, (n,), n, i + 1) for i, n in enumerate(names)], "q long, key struct<t:string>, d string, rank long")
    got = R.rrf(rows("AB"), rows("BC"), 3, 0.6, 0.4).orderBy("rank").collect()
    assert [r.d for r in got] == ["B", "A", "C"]
    assert got[0].score == pytest.approx(0.6 / 62 + 0.4 / 61)
    tie = R.rrf(rows("A"), rows("B"), 2, 1, 1).orderBy("rank").collect()
    assert [r.d for r in tie] == ["A", "B"]


def test_bm25_counts_question_tokens_twice(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a c"), (2, "d e")], "doc_id long, text string")
    ask = lambda t: R.bm25_topk(docs, spark.createDataFrame([(0, t)], "item_id long, text string"), 3).orderBy("rank").collect()
    one, two = ask("b"), ask("b b")
    assert two[0].score == pytest.approx(2 * one[0].score, abs=1e-5)
    assert len(ask("zzz")) == 3 and [r.doc_id for r in ask("zzz")] == [0, 1, 2]


@pytest.mark.parametrize("cells", [16, 4_000_000])
def test_bm25_against_the_formula(spark, monkeypatch, cells):
    """Whole scores, negative ones among them, in one block of questions and in many."""
    monkeypatch.setattr(R, "BLOCK_CELLS", cells)
    odd = [(900, None), (901, ""), (902, "the the of"), (903, " a\tb  a "), (904, "a"), (905, "a b"), (906, "a b"), (907, "a b c")]
    texts = odd + [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()]
    asked = [(1, "the of and"), (2, ""), (3, "nowhere"), (4, "the the re"), (5, "a"), (6, None)]
    for some in (odd, texts) if cells > 16 else (odd,):
        docs = spark.createDataFrame(some, "doc_id long, text string").coalesce(2)
        got = sorted(map(tuple, R.bm25_topk(docs, spark.createDataFrame(asked, "item_id long, text string"), 6).collect()))
        words = {i: (t or "").split() for i, t in some}
        df = Counter(w for ws in words.values() for w in set(ws))
        raw = {w: math.log(len(some) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
        mean, average = sum(raw.values()) / len(raw), sum(map(len, words.values())) / len(some)
        want = []
        for q, text in asked:
            score = {}
            for i, ws in words.items():
                parts = [(raw[w] if raw[w] >= 0 else 0.25 * mean) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / average)) for w in (text or "").split() if w in ws]
                score[i] = round(sum(parts), 6)
            want += [(q, i, x, rank) for rank, (x, i) in enumerate(sorted((-x, i) for i, x in score.items())[:6], 1) for x in [-x]]
        assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in sorted(want)]
        assert [x for _, _, x, _ in got] == pytest.approx([x for _, _, x, _ in sorted(want)], abs=2e-6)


@pytest.mark.parametrize("cells", [1000, 4_000_000])
def test_vectors_without_a_direction_take_no_place(spark, monkeypatch, cells):
    monkeypatch.setattr(R, "BLOCK_CELLS", cells)
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, 1.0]), (5, [None, 1.0]), (6, [-1.0, 0.0]), (7, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0]), (2, [1e-200, 1e-200])], "q long, v array<double>")
    got = sorted(map(tuple, R.dense_topk(vectors, asked, 2).collect()))
    assert got == [(0, 1, 1.0, 1), (0, 4, 0.707107, 2), (2, 1, 0.707107, 2), (2, 4, 1.0, 1)]
    assert sorted((r.q, r["rank"], r.vec_id) for r in R.mmr(vectors, asked, 2, 3, 0.5).collect()) == [(0, 1, 1), (0, 2, 4), (2, 1, 4), (2, 2, 1)]


def test_neighbours_beyond_many_blank_blocks(spark):
    texts = ["start", *[""] * 700, "a" * 300, *["x"] * 200, "", "end"]
    rows = [(0, i, "text", t, *[None] * 10) for i, t in enumerate(texts)]
    got = {r.block_idx: r for r in B.neighbour_context(spark.createDataFrame(rows, B.BLOCK_SCHEMA), 20).collect()}
    for i in (0, 1, 400, 700, 701, 702, 715, 800, 901, 902, 903):
        before, after = (" ".join(t for t in part if t) for part in (texts[:i], texts[i + 1 :]))
        assert (got[i].left, got[i].right) == (before[-20:], after[:20]), i


def test_rows_are_numbered_in_order(spark):
    values = [7 * i % 1000 for i in range(1000)] + [5, 5, None]
    rows = spark.createDataFrame([(v, "q" if i % 3 else " ") for i, v in enumerate(values)], "n long, question string").repartition(7)
    got = {r.row_id: r.n for r in E.numbered(rows, "n").collect()}
    order = sorted(values, key=lambda v: -1 if v is None else v)
    assert all(order[i - 1] == v for i, v in got.items()) and len(got) >= 660
    assert max(r.row_id for r in E.numbered(rows, "n", limit=9).collect()) <= 9
    assert E.numbered(rows.limit(0), "n").count() == 0


def test_chunks_go_back_in_bounded_batches(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(1 << 30))
    docs = spark.createDataFrame([(1, "word " * 1000), (2, ""), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in C.sliding_chunks(docs, C.ChunkSettings(100, 10)).collect()} == {1}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 8 << 20
    for text, most in (("x", C.OUT_ROWS), ("x" * 100_000, 11)):
        made = list(C._batches(((i, text) for i in range(2500)), ["i", "t"], [pa.int64(), pa.string()]))
        assert max(b.num_rows for b in made) == most and [i for b in made for i in b.column("i").to_pylist()] == list(range(2500))


def test_layout_chunks_are_made_once(spark):
    texts = ["Head", "one two. " * 30, "img", "", "three. " * 200, "tail"]
    rows = [(d, i, "table" if i == 2 else "text", None if i == 2 else t, 1 if i == 0 else None, [1, 2, 3, 4], None if d else i // 2, None, None, None, [t] if i == 2 else None, None, None, None) for d in (0, 1) for i, t in enumerate(texts)]
    made = C.layout_chunks(spark.createDataFrame(rows, B.BLOCK_SCHEMA), C.ChunkSettings(200, 50))
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.chunk_idx): r for r in made.collect()}
    assert [k for d, k in sorted(got) if d == 0] == list(range(len(got) // 2))
    assert got[0, 0].is_special and got[0, 0].special_focus.special_type == "table" and not got[0, 1].is_special
    assert got[0, 0].page_spans and set(got[0, 0].page_spans) >= {"page_1"} and got[1, 0].page_spans is None
    assert all(r.headers == ["Head"] and r.bbox for r in got.values())


def test_packs():
    assert C.pack_sizes([6, 4, 3], 10, 0) == [[0], [1], [2]]  # the text that closes a pack keeps the cost it had in it
    assert C.pack_sizes([0, 20, 0, 3, 3, 3], 10, 5) == [[0], [1, 2], [3, 4], [4, 5]]
    assert C.pack_sizes([], 10, 0) == [] and C.pack_sizes([0, 0], 10, 3) == [[0, 1]] and C.pack_sizes([5, 5], 0, 3) == [[0, 1]]


@given(st.lists(st.integers(0, 30), max_size=30), st.integers(1, 40), st.integers(0, 30))
def test_packs_hold_what_they_may(sizes, most, overlap):
    packs = C.pack_sizes(sizes, most, overlap)
    cost = lambda items: sum(sizes[i] for i in items) + 2 * max(0, sum(sizes[i] > 0 for i in items) - 1)
    own, seen = [], -1
    for p in packs:
        own.append([i for i in p if i > seen])
        carried = [i for i in p if i <= seen]
        assert carried == [] or (cost(carried) <= overlap and all(sizes[i] for i in carried) and carried[-1] == max(i for i in range(seen + 1) if sizes[i]))
        seen = p[-1]
        # more than one text of its own fits into it, but for the first text of all that a pack opens with
        assert cost(p) <= most or len([i for i in own[-1] if sizes[i]]) <= 1
    assert [i for p in own for i in p] == list(range(len(sizes)))
    # the text that opens a pack did not fit into the one before
    for a, b in zip(packs, own[1:], strict=False):
        assert cost([*a, b[0]]) + 2 > most


@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from([" ", " ", "\n", "\n\n"])), min_size=1, max_size=60), st.integers(8, 60), st.integers(0, 20))
def test_recursive_splits(parts, size, overlap):
    """Characters that come once each: pieces follow the text, leave out white space only, and share no more than the overlap."""
    letters = iter(range(0x4E00, 0x9FFF))
    text = "".join("".join(chr(next(letters)) for _ in range(n + 2)) + gap for n, gap in parts)
    end = start = 0
    pieces = C.recursive_split(text, size, overlap)
    for p in pieces:
        i = text.index(p)
        assert len(p) <= size and p == p.strip() and i >= start and text[end:i].strip() == ""
        assert end - i <= overlap
        start, end = i, i + len(p)
    assert text[end:].strip() == "" and (len(text) > size or len(pieces) == 1)


@given(st.text(alphabet="ab \n", max_size=60), st.integers(1, 12))
def test_hard_splits(text, most):
    pieces = C.hard_split(text, most)
    if len(text) <= most:
        assert pieces == [text]
        return
    assert all(0 < len(p) <= most and p == p.strip() for p in pieces)
    assert "".join(pieces).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert C.hard_split("aaaa bb cc", 6) == ["aaaa", "bb cc"] and C.hard_split("abcdefgh", 3) == ["abc", "def", "gh"] and C.hard_split("a b", 1) == ["a", "b"]


def test_token_budgets_agree(spark):
    for base, factor in ((100, 1.5), (300, 1.0), (256, 2.0), (0, 2.0)):
        rows = spark.range(6).select(T.predict_tokens(F.lit(base).cast("long"), F.col("id"), factor, 512).alias("n"), "id").collect()
        assert [r.n for r in sorted(rows, key=lambda r: r.id)] == [T.token_budget(base, i, factor, 512) for i in range(6)]


def test_judged_metrics(spark):
    answers = {"Answer Relevancy": ["yes", "no"], "Faithfulness": ["no", "no"], "Contextual Precision": ["no", "yes"]}

    def judge(prompts):
        return [None if "broken" in p else json.dumps({"verdicts": [{"verdict": v, "reason": "r"} for v in answers[next(n for n, t in zip(E.METRICS, J.TASKS) if p.startswith(t))]]}) for p in prompts]

    cases = spark.createDataFrame([(1, "q", "One. Two.", "t", ["a", "b"]), (2, "broken", "broken", "t", [])], "row_id long, input string, actual_output string, expected_output string, retrieval_context array<string>")
    got = {(r.row_id, r.name): r for r in J.judged(cases, M.Model(judge)).collect()}
    assert [(got[1, n].score, got[1, n].success) for n in E.METRICS] == [(0.5, True), (0.0, False), (0.5, True)]
    assert got[2, "Faithfulness"].score is None and not got[2, "Faithfulness"].success and got[2, "Faithfulness"].reason == "no verdict"
    stub = {r.name: r.score for r in J.judged(cases.where("row_id = 1"), M.stub_judge()).collect()}
    assert set(stub) == set(E.METRICS)


def test_rounding_is_half_even(spark):
    rows = spark.createDataFrame([(1, "m", 0.00025, 0.1, True), (2, "m", 0.00025, 0.1, True)], "row_id long, name string, score double, threshold double, success boolean")
    assert E.summary(rows).first().mean_score == 0.0002


def test_sticky_headers(spark):
    rows = [(0, i, "text", t, level) for i, (t, level) in enumerate([("One", 1), ("x", None), ("Deep", 3), ("Two", 2), ("y two", None)])]
    df = spark.createDataFrame([(*r, None, None, None, None, None, None, None, None, None) for r in rows], B.BLOCK_SCHEMA)
    got = B.with_offsets(B.segments(df)).orderBy("block_idx").collect()
    assert [r.header for r in got] == ["One", "One", "One", "Two", "Two"]
    assert [r.prefix for r in got] == ["", "", "", "", ""]
    full = B.full_text(B.with_offsets(B.segments(df))).first()
    assert [full.full_text[x.s : x.e] for x in full.spans] == ["One", "x", "Deep", "Two", "y two"]


def test_history(spark):
    turns = spark.createDataFrame([(0, i, f"u{i}", "" if i == 4 else f"a{i}") for i in range(5)], "conv_id long, turn long, user string, assistant string")
    assert sorted(r.turn for r in H.last_turns(turns, 2).collect()) == [3, 4]
    assert H.last_turns(turns, 0).count() == 0
    assert [(r.role, r.content) for r in H.messages_of(H.last_turns(turns, 2)).orderBy("seq").collect()] == [("human", "u3"), ("ai", "a3"), ("human", "u4")]


def test_summary(spark):
    rows = spark.createDataFrame([(1, "m", 0.5, 0.1, True), (2, "m", None, 0.2, False), (3, "m", 0.25, 0.3, True)], "row_id long, name string, score double, threshold double, success boolean")
    r = E.summary(rows).first()
    assert (r.mean_score, r.pass_rate, r["count"], r.threshold) == (0.375, 0.6667, 3, 0.1)


def test_contexts_are_sliced_before_blanks_go(spark):
    assert spark.range(1).select(R.prepare_contexts(F.array(*map(F.lit, ("", "x", "y"))), 2, 10).alias("c")).first().c == ["x"]


def test_latest_state(spark):
    log = spark.createDataFrame([("k", "failed", 0, "e", "2024-01-01"), ("k", "done", 3, "", "2024-01-02")], I.STATE.replace("chunks long, error string, updated_at string", "chunks long, error string, updated_at string"))
    assert I.latest_state(log).first().status == "done"


def test_models(spark):
    def fn(texts):
        if len(texts) > 1:
            raise RuntimeError("CUDA out of memory")
        if texts[0] == "bad":
            raise ValueError("no")
        return [texts[0].upper()]

    rows = spark.createDataFrame([("a",), ("bad",), ("c",)], "t string").coalesce(1)
    assert [r.v for r in rows.select(M.Model(fn).column(F.col("t"), on_error="").alias("v")).collect()] == ["A", "", "C"]
    calls = []

    def flaky(prompt, think):
        calls.append(think)
        if len(calls) == 1:
            raise RuntimeError("status 503")
        return "" if think is None else "yes"

    assert M.Retry(wait=0).call(flaky, "p") == "yes" and calls == [None, None, False]
    assert M.structured(lambda p, n: '{"a": 1}' if n == 200 else "?", "p", (100, 200)) == '{"a":1}'


def test_settings(monkeypatch):
    monkeypatch.setenv("CHUNK_SIZE", "77")
    monkeypatch.setenv("CONVERSATIONAL_RAG_ENABLED", "No")
    s = config.Settings()
    assert s.chunk_size == 77 and s.conversational is False
    assert config.parse_think("auto", "qwen3:8b") is False and config.parse_think("auto", "other") is None
    assert config.request_timeout(config.Settings(model_name="deepseek-r1:7b")) == 600
