"""HTML extraction against the known layout of the test pages, and single parts of it."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from splitlens.llm import html_extract as H
from splitlens.llm.registry import QUERIES
from splitlens.llm.staging import prepare


def article_of(source):
    """The article of a test page, whose layout is simple, by plain string work."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
    return "\n".join(x for x in parts if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_gives_the_articles(spark, sf):
    path = f"/root/testdata/{sf}"
    pages = {r.page_id: r for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    rows = QUERIES["op3_html_extraction"](spark, path).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.fixture(scope="module")
def model():
    found = [H._labelled(*s) for s in H.SEEDS]
    return H.learn(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]).astype(float))


@pytest.mark.parametrize("source, want", [
    ("<article><p>x <a href=q>link text</a> y <span class=ad>buy</span>z</p><ul class=menu><li><a>m</a></ul><table><tr><td>c1<td>c2</table></article>", "x link text y z\nc1\nc2"),
    ("<p>a<p>b &lt;i&gt; &#x41;&nbsp;c<br>d", "a\nb <i> A c d"),
    ("<article><p title='a>b'>q <script>if(a<b){}</script>r < s</p><!-- no --></article>", "q r < s"),
    ("<article><h1>T</h1><p>Text</p><section id=comments><p>Reader says hi.</p></section></article><article><p>Second.</p></article>", "T\nText\nSecond."),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<body><nav><ul><li><a href=1>Home</a></ul></nav><main><p>Main text here.</p><form><p>Sign up</p></form></main><aside>Side</aside><footer>F</footer>", "Main text here."),
    ("<main><p style='display: none'>no</p><p hidden>no</p><style>p{}</style><p>yes\n  and\tmore</p></main>", "yes and more"),
    ("<article><p>super<wbr>cali<img src=x>fragi<br>listic</p></article>", "supercalifragi listic"),
    ("<article><h2 class='section-header'>Heading</h2><p>Text under it.</p></article>", "Heading\nText under it."),
    ("<article><table><tr><td><p>in</td></p></tr></table></div><p>out</p></article>", "in\nout"),
    ("", ""), ("a < b", "a < b"), ("<div class=ad>x", ""), ("<article><p>cut off in a ta<a hr", "cut off in a ta"),
])
def test_single_pages(model, source, want):
    assert H.texts_of([source], model) == [want]


@pytest.mark.parametrize("source", ["<div>" * 50_000 + "x", "<div>" * 25_000 + "</span>" * 25_000, "<p><button>" + "<div>" * 50_000 + "x",
                                    "<table>" + "<tr><td>" * 25_000, "<div></p>" * 25_000, "<ul>" + "<li><b>" * 25_000, "<h1><span>" * 25_000])
def test_nesting_is_read_in_linear_time(source):
    start = time.perf_counter()
    H.Page(source)
    assert time.perf_counter() - start < 2


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(2, 9)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        weight, odds = np.array([rng.random() for _ in range(n)]), np.array([rng.uniform(-2, 2) for _ in range(n)])

        def total(choice):
            return sum(w * o * (1 if c else -1) for w, o, c in zip(weight, odds, choice))

        valid = [c for c in itertools.product([True, False], repeat=n) if c[0] and all(c[parent[i]] or not c[i] for i in range(1, n))]
        got = H.decode(parent, weight, odds)
        assert tuple(got.tolist()) in valid and total(got) == pytest.approx(max(map(total, valid)))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = H.fit(x[:2000], y[:2000])
    assert ((H.log_odds(model, x[2000:]) > 0) == y[2000:]).mean() > 0.93
    assert (H.log_odds(H.fit(x[:0], y[:0]), x) == 0).all()


def test_awkward_rows(spark):
    prepare(spark)
    rows = [(1, None, None, 5), (None, "u", "", 5), (2, "u", "<article><p>Text of a page.</p></article>", None), (2, "u", "<article><p>Text of a page.</p></article>", 1),
            (3, "v", "<article><p>" + "word " * 200_000 + "</p></article>", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((str(r.page_id), r.n_chars, r.text[:20]) for r in H.extract(df).collect())
    assert got == sorted([("1", 0, ""), ("None", 0, ""), ("None", 0, ""), ("2", 15, "Text of a page."), ("2", 15, "Text of a page."), ("3", 999_999, "word word word word ")])
    assert H.extract(df.limit(0)).count() == 0
