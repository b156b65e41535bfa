"""Operators on pages."""

import html
import re

import pytest

from barlytics.llm import crf, main_text, url_rules
from barlytics.llm.html_blocks import blocks
from conftest import SF


@pytest.fixture(scope="module")
def model(spark):
    return main_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a<p>b <b>c</b>d<div>e</div>f") == ["a", "b cd", "e", "f"]
    assert texts("<script>if(a<b){'</p>'}</script>x &lt;b&gt; &#8364;&nbsp; y<br>z<!-- <p>no</p> -->") == ["x <b> € y z"]
    assert texts('<p a="x>y">q</p><style>p{}</style><p b=\'<\'>r') == ["q", "r"]
    assert texts("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>5") == ["1", "2", "3", "4", "5"]
    assert texts("a < b and <3 & c &am d") == ["a < b and <3 & c &am d"]
    assert texts("") == [] and texts("<p>") == [] and texts("<script>never closed") == []
    assert texts("<" * 3000 + "x") == ["<" * 3000 + "x"]
    assert [b.linked for b in blocks("<p><a href=x>link</a> rest</p>")] == [4]


def test_an_unclosed_element_loses_only_its_tag():
    for name in ("svg", "math", "object", "canvas", "audio", "video", "template"):
        assert texts(f"<article><p>A</p><{name} src=x><p>B</p></article>") == ["A", "B"]
        assert texts(f"<p>A</p><{name}>x</{name}><p>B</p>") == ["A", "B"]
    assert texts("<p>A</p><style>p{} <p>B</p>") == ["A"]
    assert texts("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]


def test_marginals_agree_with_enumeration():
    import itertools

    import numpy as np

    scores, steps, begin, end = np.array([0.3, -1.2, 0.8, 0.1]), np.array([[0.5, -0.7], [-0.2, 0.9]]), 0.4, -0.6
    chains = list(itertools.product([0, 1], repeat=4))

    def score(y):
        return sum(s for s, k in zip(scores, y) if k) + sum(steps[a, b] for a, b in zip(y, y[1:])) + begin * y[0] + end * y[-1]

    p = np.exp([score(y) for y in chains])
    p /= p.sum()
    single, _ = crf.marginals(scores, steps, begin, end)
    assert np.allclose(single[:, 1], [(p * [y[t] for y in chains]).sum() for t in range(4)])
    best = chains[int(p.argmax())]
    assert tuple(crf.viterbi(scores.tolist(), crf.Model({}, tuple(steps.ravel()), begin, end))) == best


def test_held_out_layouts(model):
    wrong = n = 0
    for features, labels in main_text.labelled(main_text.FILLER, 150, seed=99):
        scores = [sum(model.weights.get(f, 0.0) for f in place) for place in features]
        wrong += sum(a != b for a, b in zip(crf.viterbi(scores, model), labels))
        n += len(labels)
    assert wrong / n < 0.02


def test_given_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in main_text.extract(pages, model).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_odd_pages(spark, model):
    rows = [(1, "u", None, 1), (1, "u", "", 1), (None, None, "<article><p>One text, of some length.</p></article>", 1), (2, "u", "<article>" + "<p>Many texts, and more.</p>" * 5000, 1)]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    assert [r["n_chars"] for r in got] == [0, 0, 25, 5000 * 21 + 4999]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_text.extract(empty).count() == 0


CASES = [
    ("http://net/", "net", "/", "net/", "block"), ("http://xnet/", "xnet", "/", None, "allow"), ("https://a.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"), ("http://example.com/de", "example.com", "/de", None, "allow"), ("x://a.b.org/fr/1", "a.b.org", "/fr/1", "org/fr/", "allow"),
    ("http://a.net", "a.net", "", None, "allow"), ("http://a.net?x=/", "a.net", "", None, "allow"), ("no scheme.net/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://win.casino/", "win.casino", "/", None, "block"), ("http://the-casino-win.com/a", "the-casino-win.com", "/a", None, "block"), ("http://casinos.com/a", "casinos.com", "/a", None, "allow"),
    ("http://x.com/Banner/of/museum/", "x.com", "/Banner/of/museum/", None, "allow"), ("http://x.com/banner/", "x.com", "/banner/", None, "block"), ("a://b://c.net/d", "b:", "//c.net/d", None, "allow"),
]


def test_url_cases(spark):
    rows = [(i, c[0], "x") for i, c in enumerate(CASES)] + [(None, CASES[0][0], "x"), (0, CASES[0][0], "x")]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["page_id"]][1:]
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_index_equals_trying_every_rule():
    rules = [*url_rules.listed(), *url_rules.PATTERNS, url_rules.Rule("*promo*", "block"), url_rules.Rule("||shop.*/cart^", "block")]
    index = url_rules.Index(rules, {"net": 100, "casino": 1})
    plain = url_rules.Index(rules, {})
    plain.by_token, plain.always = {}, list(range(len(plain.rules)))
    for host in ("a.net", "casino.org", "shop.x.com", "x-promos.de", "example.net", "www.example.com", "crack.climbing.org", ""):
        for path in ("", "/", "/en/a", "/fr/", "/cart", "/cart/x", "/ads/1", "/affiliate/9/click", "/redirect?url=http", "/de/casino"):
            assert index.find(host, path) == plain.find(host, path)
