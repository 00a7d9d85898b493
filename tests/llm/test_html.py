"""Blocks, the labeller's held-out accuracy, gradients, and extraction from pages of a known make."""

import html
import re
import time

import numpy as np
import pyarrow.parquet as pq

from tessera.llm import html_extraction, html_training, queries
from tessera.llm.html_blocks import blocks

PAGES = [
    (1, "u", None),
    (2, None, ""),
    (3, "u", "<html><head><title>T</title></head><body><script>x</script></body></html>"),
    (4, "u", "no tags &amp; nothing else than one line of text."),
    (5, "u", "<article><h1>Head&nbsp;line</h1><p>One\n\t two &lt;b&gt; <b>bold</b>.<p>Three é &#8364;.</article><!-- <p>no</p>"),
    (5, "u", "<article><h1>Head&nbsp;line</h1><p>One\n\t two &lt;b&gt; <b>bold</b>.<p>Three é &#8364;.</article><!-- <p>no</p>"),
    (None, "u", "<div" * 50 + ">" * 3 + "<p>x" * 500),
]


def known(page):
    """The article of the sample's one layout."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)
    lines = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", body[1])) if body else []
    return "\n".join(x for x in (" ".join(html.unescape(t).split()) for t in lines) if x)


def test_blocks():
    found = blocks(PAGES[4][2])
    assert [b.text for b in found] == ["Head line", "One two <b> bold.", "Three é €."]
    assert found[1].path == ("article", "p")
    found = blocks("<body><ul class='Main-Menu x1'><li><a href='a>b'>A</a><li>B</ul><p>t<div>u</div></p>v<textarea>no</textarea><br>w")
    assert [(b.text, b.path[-1]) for b in found] == [("A", "li"), ("B", "li"), ("t", "p"), ("u", "div"), ("v", "body"), ("w", "body")]
    assert found[0].path == ("body", "ul.main.menu.x", "li") and found[0].linked == 1
    assert blocks(None) == [] and blocks("<script>") == []


def test_left_out_elements_end_where_html_ends_them():
    text = lambda page: [b.text for b in blocks(page)]
    rest = "<p>second</p><p>third</p>"
    for tag in ("svg-icon", "video-player", "button-group", "select-box", "title_bar"):
        assert text(f'<p><{tag} name="x"></{tag}> first</p>{rest}') == ["first", "second", "third"]
    for start in ("<svg/>", "<svg class='a' />", "<math/>", "<svg hidden/>"):
        assert text(f"<p>{start} first</p>{rest}") == ["first", "second", "third"]
    for tag in ("noscript", "button", "object", "iframe", "select", "template", "canvas", "audio", "video", "svg"):
        assert text(f"<div>first <{tag} class=x>no</div>{rest}") == ["first", "second", "third"]
        assert text(f"<p>fir<{tag} class=x>no<x>no</x></{tag}>st</p>{rest}") == ["first", "second", "third"]
    assert text(f"<svg><path d='x'>{rest}") == text(f"<svg><title/><style/></svg>{rest}") == ["second", "third"]
    assert text(f"<svg><foreignObject><p>no</foreignObject><svg></svg>no</svg>{rest}") == ["second", "third"]
    assert text(f"<p>one <button><div>no</div><button>no</button> two</p>{rest}") == ["one two", "second", "third"]
    assert text(f"<object data=/a/>no</object>{rest}") == ["second", "third"]
    assert text(f"<noscript></p><p>no</noscript>{rest}<script>{rest}") == ["second", "third"]


def test_head_without_end_tag():
    text = lambda page: [b.text for b in blocks(page)]
    start = "<!doctype html><html><head><meta charset=utf-8> <title>t</title>\n<style>p{}</style><script>x</script><link rel=x> <!-- c -->"
    for body in ("<h1>one</h1><p>two", "<a href=x>one</a><p>two</p>", "one<p>two", "<img src=x>one<br>two", "<body><p>one<p>two", "</head><p>one<p>two", "<svg><g></g></svg>one<p>two"):
        assert text(start + body) == text(start + "<noscript><link></noscript>" + body) == text(start + "<noscript><link>" + body) == ["one", "two"]
    assert [b.path for b in blocks(start + "<div class=story><p>one")] == [("html", "div.story", "p")]
    assert text(start + "<template><p>no</head><body>one") == text(start + "<template><p>no<body>one") == ["one"]
    assert text(start) == text(start + "</head><body></body></html>") == []
    article = "<article><h1>Head line</h1><p>One two three, four five six.</p><p>Seven eight nine, ten.</p></article>"
    model = html_extraction.Labeller.load()
    assert html_extraction.main_texts(model, [start + article]) == html_extraction.main_texts(model, [f"{start}</head><body>{article}</body></html>"]) == ["Head line\nOne two three, four five six.\nSeven eight nine, ten."]


def test_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in html_training.initial(3).items()}
    x, mask, y = rng.normal(size=(2, 4, html_extraction.INPUT)), np.ones((2, 4)), rng.integers(0, 2, (2, 4)).astype(float)
    mask[1, 3] = 0
    _, grad = html_training.gradient(p, x, mask, y)
    for key in p:
        at = tuple(rng.integers(0, n) for n in p[key].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[key][at] += 1e-4
        down[key][at] -= 1e-4
        slope = (html_training.gradient(up, x, mask, y)[0] - html_training.gradient(down, x, mask, y)[0]) / 2e-4
        assert abs(slope - grad[key][at]) < 1e-4 + 0.02 * abs(slope)


def test_held_out_accuracy():
    """On pages whose kinds of elements, or their made-up names, training never saw; and on those of known kinds."""
    model = html_extraction.Labeller.load()
    assert html_training.accuracy(model, seed=4242, n=400) > 0.985
    assert html_training.accuracy(model, seed=4243, n=400, held=False) > 0.995


PROSE = "Words that make up a sentence of some length, with commas and other marks. And one more sentence of the same kind follows it here."
LONG_NOTICE = (
    "Subscribe to our newsletter and get the latest stories of the week in your inbox every Friday morning, free of charge and without any advertising."
)


def test_unfamiliar_layouts():
    """Pages without any telling class: labelled by hand."""
    model = html_extraction.Labeller.load()
    article = f"<h1>Title of the piece</h1><p>{PROSE}</p><p>{PROSE}</p>"
    want = f"Title of the piece\n{PROSE}\n{PROSE}"
    links = '<div class="q2"><a href="/a">One</a> <a href="/b">Two</a> <a href=c>Three</a></div>'
    cookies = '<div class="kk">We use cookies to improve your experience. Accept all</div>'
    for page in (
        f'<div class="zq1">{article}</div>{links}{cookies}',
        f"<div>{article}</div><ul><li><a href=x>Home</a><li><a href=y>About</a></ul><section><p>{LONG_NOTICE}</p></section>",
        f"<header><h1>The Site</h1></header><div>{article}</div><footer>© 2020 The Site</footer>",
        article,
        f"<section>{article}</section><section><h2>3 comments</h2><div><b>Ann</b><p>{PROSE}</p></div><div><b>Bob</b><p>No.</p></div></section>",
    ):
        assert html_extraction.main_texts(model, [f"<body>{page}</body>"]) == [want], page


def test_time_follows_length():
    """Pages of five million characters that make careless parsers quadratic."""
    size = 5_000_000
    unit = ["<a ", "<div>x", '<a b="', "<p =", "<b></i>", "<!-", "<svg><g>", "<", "&amp", "<noscript>", "</p"]
    for part in unit:
        began = time.time()
        blocks(part * (size // len(part)))
        assert time.time() - began < 60, part
    found = blocks("<div>x" * 2000 + "</div>" * 2000 + "<p>end")
    assert len(found) == 2001 and max(len(b.path) for b in found) <= 512


def test_a_long_page_in_stretches():
    model = html_extraction.Labeller.load()
    page = blocks("".join(html_training.Maker(k).page()[0] for k in range(40)))
    assert len(page) > 400
    want = model.scores([html_extraction.features(page)])[0]
    assert np.allclose(model.long_scores(page, 37), want, atol=1e-3)
    text = "<article>" + "<p>One two three, four five." * 20_000 + "</article>"
    assert html_extraction.main_texts(model, [text, None])[0].count("\n") > 19_000


def test_padding_changes_nothing():
    model = html_extraction.Labeller.load()
    pages = [f for f, _ in html_training.sample(77, 5)]
    together = model.scores(pages)
    assert all(np.allclose(model.scores([p])[0], z, atol=1e-3) for p, z in zip(pages, together, strict=True))


def test_query_on_sample(spark):
    folder = "/root/testdata/sf0.001"
    want = {r["page_id"]: known(r["html"]) for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()}
    got = {r["page_id"]: r for r in queries.op10_html_extraction(spark, folder).collect()}
    assert got.keys() == want.keys()
    wrong = [p for p in want if got[p]["text"] != want[p]]
    assert len(wrong) <= 0.02 * len(want), wrong
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_query_on_hard_pages(spark, tables):
    got = queries.op10_html_extraction(spark, tables(pages=PAGES)).collect()
    assert len(got) == len(PAGES)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[3] == ""
    assert by[5] == "Head line\nOne two <b> bold.\nThree é €."
    assert queries.op10_html_extraction(spark, tables(pages=[])).collect() == []
