import random
import time
from xml.etree import ElementTree

import pytest

from linesieve.llm import html_text

LONG = "This paragraph is long enough to count, and it has commas, too."
MORE = "Another paragraph that is long enough to count, with a comma."

PAGES = [
    (None, ""),
    ("", ""),
    ("just &lt;text&gt; &amp; no markup", "just <text> & no markup"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=1>Menu</a></nav><article><h1>Head</h1><p>{LONG}</p>"
     f"<p>a<b>b</b>c &amp;  d\n e</p><script>var x='<p>';</script></article><footer>F</footer></body></html>", f"Head {LONG} abc & d e"),
    (f'<body class="has-sidebar"><div id="header">Site</div><div id="content"><p>{LONG}</p><p>{MORE}</p><ul><li>one<li>two</ul></div>'
     f'<div class="sidebar"><p>{LONG}</p></div><section id="comments"><p>Reader: {LONG}</p></section></body>', f"{LONG} {MORE} one two"),
    (f'<div><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2><p>{MORE}</p></section></div>', f"A {LONG} B {MORE}"),
    (f'<main><div class="cookie-notice">We use cookies, many of them, every day.</div><p>{LONG}<br>x</p><aside>{MORE}</aside>'
     f'<form><p>{MORE}</p></form><div class="ad">{MORE}</div></main>', f"{LONG} x"),
    (f'<article><p>{LONG}<p>{MORE}<!-- {LONG} --><ul><li><a href=1>Related one</a><li><a href=2>Related two</a></ul>', f"{LONG} {MORE}"),
    (f"<table><tr><td>{LONG}<td>{MORE}</table>", f"{LONG} {MORE}"),
    (f"<div><div>{LONG}</div></div><div><a href=1>x</a><a href=2>y</a></div>", LONG),
    (f"<article><div class='comment'><p>{MORE}</p></div><p>{LONG} <a href=1>link, too</a></p></article>", f"{LONG} link, too"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_pages(html, text):
    assert html_text.main_text(html or "") == text


def test_extract(spark):
    rows = [(i, f"u{i}", h, "x", 7) for i, (h, _) in enumerate(PAGES)] + [(3, "u3", PAGES[3][0], "x", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = html_text.extract(df, "html", ["page_id", "url", "text"]).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    for r in out:
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text)
    assert html_text.extract(df.limit(0)).collect() == []


def test_long_page_is_read_whole():
    html = "<article>" + "".join(f"<p>Paragraph {i}, which is part of a very long page.</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(html).count("Paragraph") == 20_000


def test_deep_nesting():
    assert html_text.main_text("<div>" * 5000 + LONG + "</div>" * 5000) == LONG


@pytest.mark.parametrize("names", [
    'class="main overflow-hidden"', 'class="content no-sidebar"', 'class="elementor-widget-container"', 'class="post comments-open"',
    'class="layout-right-sidebar"', 'class="discussion"', 'class="page hidden"', 'id="widget-12"', 'title="the hidden truth"',
    'data-hidden="false"', "data-role=menu", 'data-x=" hidden "'])
def test_names_do_not_empty_a_page(names):
    article, side = f"<p>{LONG}</p><p>{MORE}</p><p>{LONG}</p>", f'<div class="sidebar"><p>{MORE}</p></div><div class="cookie-notice">{LONG}</div>'
    assert html_text.main_text(f"<body><div {names}>{article}</div></body>") == f"{LONG} {MORE} {LONG}"
    assert html_text.main_text(f"<body><section><div {names}>{article}{article}{article}</div></section>{side}</body>") == \
        " ".join([f"{LONG} {MORE} {LONG}"] * 3)


def test_articles_and_links_with_names():
    assert html_text.main_text(f'<article class="post comments related"><p>{LONG}</p><article class="comment"><p>{MORE}</p></article></article>') == LONG
    assert html_text.main_text(f'<article><p>{LONG} <a href="/hidden/valley">a valley</a></p></article>') == f"{LONG} a valley"
    assert html_text.main_text(f'<div class="menu"><p>{LONG}</p></div>') == LONG
    widgets = "".join(f'<div class="elementor-widget elementor-widget-{kind}"><{tag}>{text}</{tag}></div>'
                      for kind, tag, text in (("heading", "h2", "Head"), ("text-editor", "p", LONG), ("text-editor", "p", MORE)))
    assert html_text.main_text(f"<body><main>{widgets}</main><div class='post-comments'><p>{LONG}</p></div></body>") == f"Head {LONG} {MORE}"


def test_long_comments_are_not_the_article():
    comments = f"<p>{MORE}</p>" * 4
    assert html_text.main_text(f'<p>Hi there.</p><div class="cookie-notice">{LONG}</div>') == "Hi there."
    assert html_text.main_text(f'<h1>Head</h1><div class="comments"><p>{LONG}</p></div><div class="ad">x</div>') == f"Head {LONG}"
    for names in ('id="comments"', 'class="post-comments"', 'class="related-posts"', 'class="cookie-consent"'):
        assert html_text.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div {names}>{comments}</div></body>") == f"{LONG} {LONG}"


@pytest.mark.parametrize("part", [
    "<p><span>", "<p><span>x", "<ul><li>text", "<i><p>x</p>", "<td>x", "<table><tr><td>some text", "<div>", "<div><a href=1>x</a>",
    "<b><font>word, ", "<article>x", "<ul><li><a href=1>link</a>", '<a "', "<dl><dt>a<dd>b", "<div class=x-note>y"])
def test_time_follows_the_length_of_a_page(part):
    """Unclosed and deeply nested tags; 4,000 of them take less than half a second on an idle core."""
    start = time.process_time()
    html_text.main_text(part * 4000)
    assert time.process_time() - start < 1.5


def test_parts_of_the_article_stay():
    refs = '<ul class="references"><li><a href=1>A linked work</a></li><li><a href=2>Another one</a></li></ul>'
    assert html_text.main_text(f"<article><p>{LONG}</p>{refs}<p>{MORE}</p></article>") == f"{LONG} A linked work Another one {MORE}"
    assert html_text.main_text(f"<article><p>{LONG}</p><p>{MORE}</p>{refs}</article>") == f"{LONG} {MORE}"
    assert html_text.main_text(f"<article>{refs}<p>{LONG}</p><p>{MORE}</p></article>") == f"{LONG} {MORE}"
    for names in ('class="related-work"', 'class="notice-period"', 'id="comment-on-method"'):
        assert html_text.main_text(f"<article><p>{LONG}</p><section {names}><p>{MORE}</p></section></article>") == f"{LONG} {MORE}"
        assert html_text.main_text(f"<article><p>{LONG}</p><div class='related'><p>{MORE}</p></div></article>") == LONG


def plain_article(html):
    """A second, slow reading of the scoring for well-formed pages without names and references: every measure is taken anew."""
    root = ElementTree.fromstring(f"<root>{html}</root>")
    parent = {c: p for p in root.iter() for c in p}
    blocks, paragraphs = html_text.BLOCK, html_text.PARAGRAPHS

    def text(node):
        return " ".join("".join([f" {x} " if x else " " for x in node.itertext()]).split()) if node is not None else ""

    def size(node, inside=False):
        pieces = []

        def walk(n, linked):
            pieces.append((n.text or "", linked))
            for c in n:
                walk(c, linked or c.tag == "a")
                pieces.append((c.tail or "", linked))
        walk(node, inside)
        return sum(len(t.strip()) for t, _ in pieces), sum(len(t.strip()) for t, linked in pieces if linked)

    points = {}
    for node in root.iter():
        if node.tag in paragraphs:
            own = "" if any(c.tag in paragraphs for c in node) else text(node)
        elif node.tag in blocks:
            own = " ".join(" ".join([node.text or "", *[(text(c) if c.tag not in blocks else "") + " " + (c.tail or "") for c in node]]).split())
        else:
            own = ""
        if len(own) < 25:
            continue
        up, depth = (parent.get(node) if node.tag in paragraphs else node), 0
        while up is not None:
            points[up] = points.get(up, 0) + (1 + own.count(",") + min(len(own) / 100, 3)) * (1 if not depth else 0.5 if depth == 1 else 1 / (3 * depth))
            up, depth = parent.get(up), depth + 1
    for node in points:
        n, linked = size(node)
        points[node] *= 1 - linked / n
    return points


def test_points_are_the_plain_scorers():
    rng = random.Random(4)

    def words():
        return " ".join(rng.choice(["alpha", "beta,", "gamma", "delta.", "x"]) for _ in range(rng.randint(1, 30)))

    def inline():
        return rng.choice([words(), f"<b>{words()}</b>", f'<a href="1">{words()}</a>', f"{words()} <i>{words()} <a>y</a></i> {words()}"])

    def box(depth):
        kinds = ["p", "div", "section", "ul", "blockquote", "pre"] if depth < 6 else ["p"]
        tag = rng.choice(kinds)
        if tag in ("p", "pre"):
            return f"<{tag}>{inline()} {inline()}</{tag}>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        return f"<{tag}>" + " ".join(rng.choice([box, box, lambda d: inline()])(depth + 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    for _ in range(150):
        html = "".join(box(0) for _ in range(rng.randint(1, 4)))
        mine = html_text._score(html_text.parse(html))
        want = plain_article(html)
        assert len(mine) == len(want)
        assert [round(x, 6) for x in sorted(n.points for n in mine)] == [round(x, 6) for x in sorted(want.values())]
