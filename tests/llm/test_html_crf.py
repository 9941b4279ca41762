import html
import itertools
import re

import numpy as np
import pytest

from lectern.llm import html_crf as H


@pytest.fixture(scope="module")
def model():
    return H.train(H.training_pages())


def test_blocks():
    page = '<body><nav><ul><li><a href=x>One</a><li>Two</ul></nav><p>A<b>b</b>  c &amp; d<br>next<p>last<script>var t="</p>";</script> end<!-- x --></body>'
    assert [b.text for b in H.blocks(page)] == ["One", "Two", "Ab c & d", "next", "last end"]
    assert H.blocks("<p>5 < 6 and text") and H.blocks("") == []
    assert [b.text for b in H.blocks("a<!-- never closed <p>b")] == ["a"]


def test_broken_tags_leave_nothing_in_the_text():
    said = lambda page: [b.text for b in H.blocks(page)]
    assert said("<p title=it's>Hello</p>") == ["Hello"]
    assert said('<p title="never closed>Hello <a href="x y">go</a></p>') == ["Hello go"]
    assert said("<p title='it's fine' hidden>Hi</p><p class='a > b'>yes</p>") == ["Hi", "yes"]
    assert said('<div data-x="<b>q</b>" id=k>in</div>') == ["in"]
    assert said("<script src=a.js/>var a=1;</script>after") == ["after"]
    assert said("<script src='x'/>mid <script>var b</script>end") == ["mid end"]
    assert said("<svg/>x<style>p{}</style>y<script>never closed") == ["xy"]
    assert said("a < b and <3 <b>c</b> <p disabled") == ["a < b and <3 c"]
    page = "<p a=\"" * 3000 + "'<" * 3000
    assert isinstance(H.blocks(page), list)


def test_viterbi_is_the_best_path(model):
    rng = np.random.default_rng(0)
    for _ in range(30):
        found = [H.Block((f"<{t}>",), "word " * int(n), 0) for t, n in zip(rng.choice(["p", "nav", "li", "footer"], 6), rng.integers(1, 40, 6), strict=True)]
        unary = model.scores(found)

        def score(path):
            out = model.start[path[0]] + unary[0] * path[0]
            return out + sum(model.moves[a, b] + u * b for a, b, u in zip(path, path[1:], unary[1:]))

        best = max(itertools.product((0, 1), repeat=6), key=score)
        assert score(tuple(map(int, model.decode(found)))) == pytest.approx(score(best))


def test_held_out_blocks(model):
    wrong = total = 0
    for page, labels in H.training_pages(150, seed=123):
        wrong += sum(a != b for a, b in zip(model.decode(H.blocks(page)), labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.05


def test_pages(spark, model):
    def article(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))).split())

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = H.main_text(pages, model=model).join(pages.select("page_id", "html"), "page_id").collect()
    assert sum(r.text == article(r.html) for r in rows) / len(rows) > 0.98
    assert all(r.n_chars == len(r.text) for r in rows)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (None, "u", "<<<>>&amp;<p", "x"), (4, "u", "<p>" + "word " * 200_000, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.main_text(odd, model=model).collect()}
    assert got[1].text == "" and got[2].n_chars == 0 and len(got) == 4
    assert H.main_text(odd.limit(0), model=model).count() == 0
    twice = pages.limit(3).unionByName(pages.limit(3))
    assert sorted(r["count"] for r in H.main_text(twice, model=model).groupBy("page_id", "text").count().collect()) == [2, 2, 2]


def test_unicode_white_space_is_one_blank():
    found = H.blocks("<p>\u2003a&emsp;\u3000\u2028\u00a0 \n b\u2029</p>")
    assert [b.text for b in found] == ["a b"]
