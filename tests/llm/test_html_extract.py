import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from ravelin.llm import html_extract as h

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy this now.</div>
<article><h1>Head &amp; line</h1><p><b>Head &amp; line<br><p>First  paragraph of
 the story, with <a href=x>a link</a> in it.</p><p>Second paragraph &copy; here is longer than the first one.</p></article>
<footer>&copy; a.example.com &middot; All rights.</footer></body></html>"""


@pytest.fixture(scope="module")
def net():
    return h.trained()


def test_blocks():
    got = [b.text for b in h.blocks(PAGE)]
    assert got == ["T", "Home", "News", "Buy this now.", "Head & line", "Head & line", "First paragraph of the story, with a link in it.", "Second paragraph © here is longer than the first one.", "© a.example.com · All rights."]
    assert [b.text for b in h.blocks("a<br>b <i>c</i>d<p>e &lt; f")] == ["a b cd", "e < f"]
    assert [b.text for b in h.blocks("1 < 2 <!-- open <p>x")] == ["1 < 2"]
    assert [b.text for b in h.blocks("<p>x<script>no</p>")] == ["x"]
    assert [b.text for b in h.blocks('<p title="a > b">x</p><div')] == ["x"]
    assert h.blocks("") == [] and h.blocks("<p></p>") == []


def test_extracts_the_article(net):
    assert h.main_text(net, [PAGE]) == ["Head & line\n\nHead & line\n\nFirst paragraph of the story, with a link in it.\n\nSecond paragraph © here is longer than the first one."]


def test_other_layouts(net):
    body = "".join(f"<p>Paragraph {i} tells a long story about things, and goes on.</p>" for i in range(4))
    page = f"""<body><div class="cookie-notice">We use cookies <button>Accept</button></div><header><div class="logo">Site</div></header>
      <div id="sidebar"><h3>Related</h3><ul><li><a href=1>One</a></li></ul></div><form class="search"><label>Search</label><input></form>
      <div class="post-content">{body}</div><div class="comments"><h3>2 Comments</h3><p>Nice story, thank you very much for it.</p></div><div class="footer">Copyright</div>"""
    assert h.main_text(net, [page])[0].split("\n\n") == [f"Paragraph {i} tells a long story about things, and goes on." for i in range(4)]


def test_held_out_accuracy(net):
    pages, labels = h.examples(200, 4242)
    got = net.label(pages)
    right = np.concatenate([(p >= 0.5) == (y > 0) for p, y in zip(got, labels, strict=True)])
    assert right.mean() > 0.99


def test_gradient():
    """The backward pass against finite differences."""
    pages, labels = h.examples(3, 8)
    net = h.Net(1)
    x, mask = net.batch([net.inputs(p) for p in pages])
    y = np.zeros(mask.shape)
    for j, v in enumerate(labels):
        y[: len(v), j] = v

    def loss():
        z = net.logits(x, mask)[0]
        return float((np.where(mask, np.logaddexp(0, z) - y * z, 0)).sum() / mask.sum())

    z, both, kf, _ = net.logits(x, mask)
    dz = np.where(mask, 1 / (1 + np.exp(-z)) - y, 0) / mask.sum()
    dh = (dz[:, :, None] * net.par["o"])[:, :, : h.HIDDEN]
    _, dwx, dwh, _ = net.back(x[0], mask, net.par["xf"], net.par["hf"], dh, kf)
    for name, grad, at in (("xf", dwx, (3, 5)), ("hf", dwh, (2, 40))):
        net.par[name][at] += 1e-5
        up = loss()
        net.par[name][at] -= 2e-5
        down = loss()
        net.par[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_table(spark, net):
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, "u", "Just a plain sentence without any tag at all, long enough to read."), (5, "u", "<article>" + "<p>Some words of a paragraph here.</p>" * 3000 + "</article>"), (6, "u", "<nav><a href=x>Home</a></nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.url): r for r in h.extracted(df).collect()}
    assert got[(1, "u")].text == "" and got[(2, None)].n_chars == 0 and got[(6, "u")].text == ""
    assert got[(5, "u")].text.count("\n\n") == 2999 and got[(None, "u")].n_chars == len(rows[4][2])
    assert got[(3, "u")].n_chars == len(h.main_text(net, [PAGE])[0])
    assert h.extracted(df.limit(0)).count() == 0


def test_long_pages_in_chunks(monkeypatch):
    """A page read in chunks gets the logits of the page read at once."""
    from ravelin.llm import html_extract as h

    net = h.Net(seed=9)
    page = h.blocks("".join(f"<div class='c{i % 7}'><p>word{i} and {i * 31} more.</p></div>" for i in range(137)))
    whole = net.label([page])[0]
    monkeypatch.setattr(h, "CHUNK", 10)
    assert abs(net.label([page])[0] - whole).max() < 1e-9


def test_icons_and_unclosed_elements():
    from ravelin.llm import html_extract as h

    text = lambda s: [b.text for b in h.blocks(s)]
    assert text("<p>a <svg class='i'/> b</p><p>c</p>") == ["a b", "c"]
    assert text("<p>a</p><svg-icon><p>b</p></svg-icon><template-card>c</template-card>") == ["a", "b", "c"]
    assert text("<p>a</p><svg><path d='x'><p>b</p>") == ["a", "b"]
    assert text("<p>a</p><svg><title>t</title></svg><p>b</p><script>x<y</p>") == ["a", "b"]


@pytest.mark.parametrize(("page", "text"), [
    ("<svg><p>x</p>" * 80_000, 80_000),
    ("<template><noscript>a" * 50_000, 1),
    ("<div>a" * 100_000, 100_000),
    ("<div>" * 100_000 + "x" + "</p>" * 100_000, 1),
    ("<!" * 500_000, 0),
    ("<!-- a --><svg>" * 60_000 + "</svg>" + "y", 1),
    ('<p class="' + "ab " * 300_000 + '">x<b>' * 3, 1),
], ids=["svg", "template", "div", "unmatched", "declaration", "swallowed", "class"])
def test_bad_markup_takes_linear_time(page, text):
    """A megabyte of unclosed or deep elements is parsed in seconds."""
    began = time.process_time()
    found = h.blocks(page)
    assert len(found) == text and time.process_time() - began < 5
    assert max((len(b.path) for b in found), default=0) <= h.DEPTH * (h.NAMES + 1)
