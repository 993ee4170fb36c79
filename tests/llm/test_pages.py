"""Main text of pages that no generator wrote, of broken markup, and of very long pages."""

import math
import time

import numpy as np
import pytest

from ledgermark.llm import html_blocks

PAGES = {
    "blog": (
        """<!doctype html><html><body class="home blog logged-out"><div id="page" class="hfeed site"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><p class="site-title"><a href="/">Slow Bread</a></p><p class="site-description">Notes from a small kitchen</p></header>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li class="menu-item"><a href="/">Start</a></li><li class="menu-item"><a href="/all">All recipes</a></li><li><a href="/me">Who I am</a></li></ul></nav>
<div id="content" class="site-content"><main id="main"><article id="post-12" class="post-12 post type-post hentry"><h1 class="entry-title">Rye in winter</h1>
<div class="entry-content"><p>Cold flour makes a slow dough, and a slow dough makes a better loaf.</p><p>Mix 400&nbsp;g of rye with water <em>as warm as your hand</em>, then wait.</p><ul><li>One day for the starter</li><li>One night for the dough</li></ul><p>Bake it dark.</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this post</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>I baked it twice and it was heavy both times.</p><a class="comment-reply-link" href="#">Reply</a></div></li></ol></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2 class="widget-title">Recent</h2><ul><li><a href="/a">Spelt rolls</a></li><li><a href="/b">Old ovens</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly baked since 2011</div></footer></div></body></html>""",
        'Rye in winter Cold flour makes a slow dough, and a slow dough makes a better loaf. Mix 400 g of rye with water as warm as your hand, then wait. One day for the starter One night for the dough Bake it dark.',
    ),
    "news": (
        """<html><body><div class="cookie-consent" role="dialog"><p>We and our partners store data on your device.</p><button>Agree</button></div>
<header class="page-header"><div class="logo"><a href="/">The Harbour Post</a></div><nav class="nav-primary"><a href="/w">World</a> <a href="/l">Local</a> <a href="/s">Sport</a></nav></header>
<div class="breadcrumbs"><a href="/">Front</a> &rsaquo; <a href="/l">Local</a></div>
<main role="main"><article class="story"><h1>Ferry to run all year</h1><p class="lead">The island ferry will sail on winter Sundays from November, the council said on Monday.</p>
<div class="ad-slot ad-slot--mpu"><p>Advertisement</p></div><p>Until now the last boat left in October. "We have asked for this since 1987," said Ane Holm, who keeps the island's shop.</p><h2>What it costs</h2><p>A return ticket will cost 12 crowns; children travel free.</p></article>
<div class="social-share"><a href="#">Post</a> <a href="#">Mail</a></div></main>
<aside class="sidebar related-stories"><h3>More on this</h3><ul><li><a href="/1">Bridge closed again</a></li><li><a href="/2">Shop wins prize</a></li></ul></aside>
<section class="newsletter"><form action="/n"><label>Get the morning mail</label><input type="email"><button>Sign up</button></form></section>
<footer><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul><p>&copy; The Harbour Post</p></footer></body></html>""",
        'Ferry to run all year The island ferry will sail on winter Sundays from November, the council said on Monday. Until now the last boat left in October. "We have asked for this since 1987," said Ane Holm, who keeps the island\'s shop. What it costs A return ticket will cost 12 crowns; children travel free.',
    ),
    "old": (
        """<HTML><BODY BGCOLOR=white><TABLE><TR><TD><DIV ID=nav CLASS=menu><A HREF=index.html>Index</A><BR><A HREF=maps.html>Maps</A></DIV></TD><TD><DIV CLASS=content><H1>Of lighthouses</H1>
<P>The first tower stood on the spit until the flood of 1717.<P>Its keeper, it's said, slept by day.<BR>His wife kept the books.<P>The second tower still stands.</DIV></TD></TR></TABLE><DIV CLASS=footer>Last changed in May</DIV></BODY></HTML>""",
        "Of lighthouses The first tower stood on the spit until the flood of 1717. Its keeper, it's said, slept by day. His wife kept the books. The second tower still stands.",
    ),
    "app": (
        """<body><div id="__next"><div class="css-1a2b3c"><nav class="css-9f8e7d"><ul><li><a href="/p">Pricing</a></li><li><a href="/d">Docs</a></li><li><a href="/j">Jobs</a></li></ul></nav></div>
<main class="css-77aa11"><article class="css-0d0d0d"><h1 class="css-5e5e5e">Why we moved to queues</h1><p class="css-3c3c3c">Last spring our importer fell over twice a week, always at night and always on the same table.</p><p class="css-3c3c3c">We put a queue before it, and the nights became quiet. This is how it works, and what it cost us in the end.</p><blockquote><p>Measure first, then cut.</p></blockquote></article></main>
<footer class="css-222222"><a href="/imprint">Imprint</a><a href="/x">Status</a></footer></div></body>""",
        'Why we moved to queues Last spring our importer fell over twice a week, always at night and always on the same table. We put a queue before it, and the nights became quiet. This is how it works, and what it cost us in the end. Measure first, then cut.',
    ),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_pages_of_other_makers(name):
    page, want = PAGES[name]
    assert html_blocks.main_texts(html_blocks.train(), [page])[0][0] == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p title=it's>one</p><p>isn't</p>", ["one", "isn't"]), ('<div class="a"">two</div>', ["two"]), ('<p title="unclosed>three</p><p>x</p>', ["three", "x"]), ("<a href=/x/>c</a> a < b", ["c a < b"]),
        ("<!--><p>a</p><!-- x --!><p>b</p>", ["a", "b"]), ("<script src=x />var</script>z", ["z"]), ("<p data-x='a>b' id=q>in</p>", ["in"]), ("<p>cut <b class='", ["cut"]), ("<", ["<"]), ("</p><p/>x", ["x"]),
        ("<div " + "a=b " * 5000 + ">many</div>", ["many"]), ("<p =x>odd", ["odd"]), ("<p a='1'b=\"2\">near", ["near"]),
    ],
)
def test_markup_as_browsers_read_it(page, want):
    assert [b.text for b in html_blocks.leaf_blocks(page)] == want


def test_names_of_attributes():
    (b,) = html_blocks.leaf_blocks("<div data-id='no' ID=siteHeader class='großer NAV' class=second>x</div>")
    assert {"i:site", "i:header", "c:nav", "c:gro", "c:ß", "c:er"} <= set(b.path) and not {"c:second", "i:no"} & set(b.path)


def test_a_long_page_is_read_in_stretches():
    """The same answers as in one piece, whatever the stretch; depth and attributes cost no more than their length."""
    net = html_blocks.train()
    page = "<nav><a href=/>x</a></nav><article>" + "".join(f"<p>Line {i} of a long text.</p><div class=ad>Buy {i}</div>" for i in range(150)) + "</article><footer>end</footer>"
    blocks = html_blocks.leaf_blocks(page)
    x, mask = html_blocks.padded([html_blocks.vectors(blocks)])
    whole = net.predict(x, mask)[:, 0]
    for stretch in (1, 7, 100, 10_000):
        assert np.allclose(net.predict_page(blocks, stretch), whole, atol=1e-4)
    began = time.time()
    deep = html_blocks.leaf_blocks("<div class=x>" * 200_000 + "bottom" + "<p>x" * 100_000)
    assert len(deep) == 100_001 and len(deep[0].path) <= 3 * html_blocks.DEPTH and time.time() - began < 120


def test_blocks_of_a_huge_page_share_their_paths():
    blocks = html_blocks.leaf_blocks("<div id=a><div class=b>" + "<p class='c d'>word</p>" * 300_000)
    assert len(blocks) == 300_000 and len({id(b.path) for b in blocks}) == 1


def test_a_deep_sidebar_stays_one():
    """Elements below the last noted level end as others do: what they are in goes on after them."""
    n = 2000
    page = f"<article><p>One.</p><aside>{'<div>' * n}deep{'</div>' * n}<p>Still aside.</p></aside><p>Two.</p></article>"
    by = {b.text: b.path for b in html_blocks.leaf_blocks(page)}
    assert "aside" in by["deep"] and by["Still aside."] == ("article", "aside", "p") and by["Two."] == by["One."] == ("article", "p")
    began = time.time()
    odd = html_blocks.leaf_blocks("<div>" * 50_000 + "</span></table>" * 50_000 + "x")  # ends of what is not open cost nothing
    assert len(odd) == 1 and time.time() - began < 30


def loop_probabilities(net, x):
    """The network by the book: one cell, one number at a time, in both directions."""
    h = html_blocks.HIDDEN
    sig = lambda z: 1 / (1 + math.exp(-max(-30, min(30, z))))
    states = {}
    for d in "fb":
        wx, wh, b = (net.p[f"{k}{d}"] for k in ("wx", "wh", "b"))
        hidden, cell, out = [0.0] * h, [0.0] * h, {}
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = [b[j] + sum(x[t][i] * wx[i][j] for i in range(len(x[t])) if x[t][i]) + sum(hidden[i] * wh[i][j] for i in range(h)) for j in range(4 * h)]
            cell = [sig(z[h + j]) * cell[j] + sig(z[j]) * math.tanh(z[3 * h + j]) for j in range(h)]
            hidden = [sig(z[2 * h + j]) * math.tanh(cell[j]) for j in range(h)]
            out[t] = hidden
        states[d] = out
    wo = net.p["wo"]
    return [sig(net.p["bo"][0] + sum(wo[j] * states["f"][t][j] + wo[h + j] * states["b"][t][j] for j in range(h))) for t in range(len(x))]


def test_labels_equal_a_network_of_loops(spark):
    """What the query returns against the network by the book, whose input, forget and output gates come in this order."""
    net = html_blocks.train()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").limit(6)
    got = {r["page_id"]: r for r in html_blocks.extract(pages).collect()}
    for page in pages.collect():
        blocks = html_blocks.leaf_blocks(page["html"])
        p = loop_probabilities(net, html_blocks.vectors(blocks).tolist())
        x, mask = html_blocks.padded([html_blocks.vectors(blocks)])
        assert np.allclose(net.predict(x, mask)[:, 0], p, atol=1e-4)
        text = " ".join(b.text for b, q in zip(blocks, p, strict=True) if q >= 0.5)
        assert got[page["page_id"]]["text"] == text and got[page["page_id"]]["n_chars"] == len(text)


def test_gradients_are_slopes_of_the_loss():
    """Back-propagation against small steps of each kind of weight."""
    r = np.random.default_rng(3)
    net = html_blocks.Labeller(5)
    x = r.normal(0, 0.3, (4, 2, html_blocks.DIMS))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = r.integers(0, 2, mask.shape).astype(float)
    _, g = net.gradients(x, mask, y)
    for name, w in net.p.items():
        for at in (tuple(int(r.integers(n)) for n in w.shape) for _ in range(4)):
            was = w[at]
            w[at] = was + 1e-5
            up, _ = net.gradients(x, mask, y)
            w[at] = was - 1e-5
            down, _ = net.gradients(x, mask, y)
            w[at] = was
            assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), name
