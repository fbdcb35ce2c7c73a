"""The reader against the standard library's, the random field against sums over all labellings, extraction on held-out pages."""

import itertools
from html.parser import HTMLParser

import numpy as np
import pytest

from glint.llm import html_blocks, labelled_pages, main_text
from glint.llm.main_text import Model


def texts(html):
    return [t for t, _ in html_blocks.blocks(html)]


def above(html):
    return {t: f for t, f in html_blocks.blocks(html)}


@pytest.mark.parametrize(
    "html, found",
    [
        (None, []), ("", []), ("  \n ", []), ("<p></p><br>", []), ("plain &amp; &lt;b&gt; &eacute;&#65;&am", ["plain & <b> éA&am"]),
        ("<p>a<b>b</b>c<br>d\n\t e<p>f", ["abc", "d e", "f"]), ("x<!-- <p>no</p> --><!-->y<!-- open", ["xy"]), ("a<script>var t='</p>'; if (a<b) {}</SCRIPT >b<style>p{}</style><title>no</title>c", ["abc"]),
        ("<script>never closed <p>a", []), ("<a title='x > y' href=z>l</a> < 3 <5 &lt;", ["l < 3 <5 <"]), ("a<foot", ["a"]), ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>5", ["1", "2", "3", "4", "5"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]), ("a&nbsp;b c", ["a b c"]), ("İ<TITLE>x</TITLE>z", ["İz"]), ('<p class="unclosed>a</p><p>b', ["a", "b"]),
    ],
)
def test_blocks(html, found):
    assert texts(html) == found


def test_features_name_what_is_open():
    f = above("<div class='adBox side-bar'>x</div><article id=main><header><h1>y</h1></header><p>z <a href=#>link</a></p></article>")
    assert {"in:div", "name:ad", "name:box", "name:side", "name:bar", "sections:"} <= set(f["x"])
    assert {"in:article", "name:main", "in:h1", "parent:h1", "sections:article>header"} <= set(f["y"])
    assert {"sections:article", "parent:p", "links:2", "in:article"} <= set(f["z link"]) and "name:ad" not in f["z link"]
    some = dict(html_blocks.blocks("<nav><p>a</p></nav>", {"in:nav": 1}))
    assert some == {"a": ["in:nav"]}


def test_long_and_deep_pages_are_read_whole():
    assert len(texts("<div class=x><b>t" * 20_000)) == 20_000
    assert len(texts("<b>t<br>" * 50_000)) == 50_000
    assert texts("<p>" + "word " * 500_000)[0].count("word") == 500_000
    assert len(texts('<a "<i \'<' * 50_000)) == 0


def small(seed):
    rng = np.random.default_rng(seed)
    return [([[f"f{k}" for k in range(4) if rng.random() < 0.5] for _ in range(n)], rng.integers(0, 2, n).tolist()) for n in (4, 1, 3, 5, 4)]


def score(x, names, features, labels):
    s = sum((y - 0.5) * x[names.index(f)] for own, y in zip(features, labels, strict=True) for f in own)
    return s + sum(x[len(names) + 2 * a + b] for a, b in zip(labels, labels[1:], strict=False))


def test_fit_is_the_optimum_of_the_likelihood_summed_over_all_labellings(monkeypatch):
    monkeypatch.setattr(main_text, "LEAST", 1)
    pages = small(3)
    model = main_text.trained(pages)
    names = sorted(model.weights)
    x = np.array([model.weights[f] for f in names] + [w for row in model.passes for w in row])

    def loss(x):
        out = main_text.PRIOR * (x @ x)
        for features, labels in pages:
            every = [score(x, names, features, y) for y in itertools.product((0, 1), repeat=len(labels))]
            out += np.logaddexp.reduce(every) - score(x, names, features, labels)
        return out

    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-4
        assert abs(loss(x + step) - loss(x - step)) / 2e-4 < 0.02
        assert loss(x) < min(loss(x + 1e3 * step), loss(x - 1e3 * step))


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(1)
    assert main_text.decoded([], ((0, 0), (0, 0))) == []
    for _ in range(50):
        s, p = rng.normal(size=rng.integers(1, 9)), rng.normal(size=(2, 2))
        of = lambda y: sum((b - 0.5) * v for b, v in zip(y, s, strict=True)) + sum(p[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert of(main_text.decoded(s.tolist(), tuple(map(tuple, p.tolist())))) == pytest.approx(max(map(of, itertools.product((0, 1), repeat=len(s)))))


@pytest.fixture(scope="module")
def model(spark):
    return main_text.fit(labelled_pages.sample(spark, 1200))


def test_held_out_labelled_pages(model):
    hit = said = true = used = 0
    for html, main in labelled_pages.written(300, 10**6):
        features, y = main_text.labelled(html, main)
        used += bool(features)
        z = main_text.decoded([sum(model.weights.get(f, 0) for f in own) for own in features], model.passes)
        hit, said, true = hit + sum(a and b for a, b in zip(y, z, strict=True)), said + sum(z), true + sum(y)
    print("held-out blocks: precision", hit / said, "recall", hit / true)
    assert used >= 290 and hit / said > 0.97 and hit / true > 0.97


class _Articles(HTMLParser):
    """The words in article elements, a space for every tag but b."""

    def __init__(self):
        super().__init__()
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out.append("" if tag == "b" else " ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.out.append("" if tag == "b" else " ")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_pages_of_the_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in main_text.extract(pages, model).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        reader = _Articles()
        reader.feed(r["html"])
        reader.close()
        assert found[r["page_id"]] == " ".join("".join(reader.out).split())


def test_other_layouts(model):
    html = """<html><body><div class="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept</button></div><header><a href="/">Site</a></header>
    <nav><a href="/a">Home</a> <a href="/b">News</a></nav><aside><h3>Most read</h3><p>Some other story that many have read today.</p></aside>
    <main><h1>The title</h1><p>First paragraph &amp; more, with <a href="#">a link</a>.</p><div class="advert">Buy this now.</div><ul><li>One item</li><li>Two items</li></ul><p>Last.</p></main>
    <section id="comments"><h2>Comments</h2><p>I don't agree with this article at all, and here is why.</p></section><form><label>Mail</label><input></form><footer>&copy; 2020 Site</footer></body></html>"""
    assert main_text.main_text(html, model) == "The title First paragraph & more, with a link. One item Two items Last."


def test_rows_and_columns(spark, model):
    rows = [(None, None, None), (1, "u", ""), (2, "u", "<nav><a href=x>Home</a></nav>"), (3, None, "<article><p>a b</article>"), (3, None, "<article><p>a b</article>"), (4, "u", "<article><p>" + "long text " * 300_000)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as features")
    found = sorted(map(tuple, main_text.extract(df, model).collect()), key=str)
    assert [(*r[:2], r[2][:9], r[3]) for r in found] == sorted([(None, None, "", 0), (1, "u", "", 0), (2, "u", "", 0), (3, None, "a b", 3), (3, None, "a b", 3), (4, "u", "long text", 2_999_999)], key=str)
    assert main_text.extract(df.limit(0), model).count() == 0
    assert main_text.trained([]) == Model({}, ((0.0, 0.0), (0.0, 0.0)))
