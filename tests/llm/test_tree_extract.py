from __future__ import annotations

import time

import pytest

from tollgate.llm.tree_extract import extract_pages, main_text

LONG = "First paragraph, with a comma, and enough of text to count as a paragraph of the article."
MORE = "Second one &amp; its entity &lt;b&gt;, as long as the first, so that it counts as well."
MORE_TEXT = "Second one & its entity <b>, as long as the first, so that it counts as well."
ARTICLE = f"<h1>Title</h1><p>{LONG}</p><p>{MORE}</p><p>Short.</p>"
TEXT = f"Title\n\n{LONG}\n\n{MORE_TEXT}\n\nShort."
AROUND = (
    '<header><a href="/">Site</a> of news</header><nav><ul><li><a href="/a">A</a></li></ul></nav>',
    '<div class="ad">Buy this now, it is cheap, it is good, it is new, and it is here.</div>',
    '<div id="cookie-notice"><p>We use cookies, as all do, and more, and more, and so on, and on.</p></div>',
    '<aside class="sidebar"><p>See also this, and that, and something else, which is long enough too.</p></aside>',
    '<form><label>Mail</label><input><p>Write to us, please, with all that you want to say, or not.</p></form>',
    "<script>var t = '<p>not, a, text, at, all, however long it is</p>';</script><style>p{}</style><!-- <p>x</p> -->",
    '<section class="comments"><p>I, as a reader, think, that this, and that, is wrong, wrong, wrong.</p></section>',
    "<footer>&copy; Someone, somewhere, some time, all rights are reserved by all of them.</footer>",
)


@pytest.mark.parametrize("tag", ["article", "main", 'div id="content"', 'div class="post-body"', "section", "div"])
def test_article_among_all_else(tag):
    closing = tag.split()[0]
    page = f"<html><head><title>T</title></head><body>{''.join(AROUND)}<{tag}>{ARTICLE}</{closing}>{AROUND[7]}</body>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("part", AROUND)
def test_parts_inside_the_article_go(part):
    if part.startswith("<header"):
        return  # an article's own header holds its title
    assert main_text(f"<body><article>{ARTICLE}{part}</article></body>") == TEXT


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("no markup, just a text that is long enough", "no markup, just a text that is long enough"),
        (f"<p>{LONG}<p>{LONG}", f"{LONG}\n\n{LONG}"),
        (f"<article><p><b>{LONG}<br>next\n  line<p>end</article>", f"{LONG} next line\n\nend"),
        ("<article><p>x</p></article><div class=ad><p>" + LONG + "</p></div>", "x"),
        (f"<article><ul><li>one<li>two</ul><p>{LONG}</article>", f"one\n\ntwo\n\n{LONG}"),
        (f"<article><table><tr><td>a<td>b<tr><td>c</table><p>{LONG}</article>", f"a\n\nb\n\nc\n\n{LONG}"),
        (f"<ARTICLE CLASS='x'><P>{LONG}</P></ARTICLE>", LONG),
        ("<article><p>a < b and b > c, 1 <2</p></article>", "a < b and b > c, 1 <2"),
        (f"<article><p>{LONG}</p><script>x = '</article>'", LONG),
        ("<article><p>&#72;&eacute;&nbsp;&#x4e00; &unknown; &amp</p></article>", "Hé 一 &unknown; &"),
        (f'<body class="has-sidebar"><div class="content with-sidebar"><p>{LONG}</p></div>', LONG),
        (f"<nav><ul><li>menu<article><p>{LONG}</p></article>", LONG),
        (f"<form><article><p>{LONG}</p></article></form>", LONG),
        ('<div><p title="a > b">' + LONG + "</p></div>", LONG),
        (f"<div><a href=1>{LONG}</a></div><div><p>{LONG}</p></div>", LONG),
    ],
)
def test_markup(html, text):
    assert main_text(html) == text


def test_broken_and_deep_pages_end():
    assert main_text("<div>" * 20_000 + LONG) == LONG
    assert main_text('<a "' * 20_000) is not None
    assert main_text("<!--" * 20_000) == ""
    assert main_text("<p>" * 20_000 + LONG) == LONG


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = f"<body><article>{ARTICLE}</article></body>"
    rows = [(1, "u", page, "x", "y"), (2, None, None, None, None), (None, "v", "", "", ""), (1, "u", page, "x", "y")]
    rows.append((3, "w", "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>", "", ""))
    found = sorted((tuple(r) for r in extract_pages(spark.createDataFrame(rows, schema)).collect()), key=repr)
    whole = "\n\n".join([LONG] * 20_000)
    expected = [(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", whole, len(whole))]
    assert found == sorted(expected, key=repr)
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0


UNEVEN = ["p" * 99 + ", and, " + "q" * 94] * 4, "s" * 60 + ", and " + "t" * 54


@pytest.mark.parametrize(
    "opening", ["div", "div id=content", "div class=post-body", "div role=main", 'div role="Main"', "div class=page"]
)
def test_short_sections_stay(opening):
    first = "".join(f"<p>{p}</p>" for p in UNEVEN[0])
    second = f"<section><h2>Second</h2><p>{UNEVEN[1]}</p></section><section><h2>End</h2><p>Short.</p></section>"
    links = "<div><a href=1>one link, and more</a> <a href=2>another link, and more</a></div>"
    page = f"<body>{''.join(AROUND)}<{opening}><section>{first}</section>{second}</div>{links}</body>"
    assert main_text(page) == "\n\n".join([*UNEVEN[0], "Second", UNEVEN[1], "End", "Short."])


@pytest.mark.parametrize("opening", ["div id=content", "div class=post-body", "div role=main", "div class='entryContent'"])
def test_sections_within_further_containers_stay(opening):
    first = "".join(f"<p>{p}</p>" for p in UNEVEN[0])
    page = f"<body><{opening}><div><section>{first}</section></div><div><section><p>{UNEVEN[1]}</p></section></div></div></body>"
    assert main_text(page) == "\n\n".join([*UNEVEN[0], UNEVEN[1]])


SENTENCES = "A sentence of the article, with commas, that is long enough to count as text of its own. " * 3
BODY = "".join(f"<p>{i} {SENTENCES}</p>" for i in range(4))
KEPT = "\n\n".join(f"{i} {SENTENCES}".strip() for i in range(4))


@pytest.mark.parametrize(
    "page",
    [
        # the whole page is one form
        f'<html><body><form method="post" action="x.aspx"><input type="hidden"><div id="c">{BODY}</div></form></body></html>',
        # self-closed and unclosed elements that hold no text
        f'<body><article><svg width="1"/>{BODY}</article></body>',
        f'<body><article><p>0 {SENTENCES}</p><video src="v"><p>1 {SENTENCES}</p><iframe src="x"><p>2 {SENTENCES}</p><audio><p>3 {SENTENCES}</p></article></body>',
        # capitals, and a letter whose lower case is longer
        f"<BODY><SCRIPT>var \u0130 = 1;</SCRIPT><ARTICLE>{BODY}</ARTICLE><STYLE>p {{}}</STYLE></BODY>",
        # wrappers named by what stands beside the article
        f'<body><div class="sidebar-layout"><div class="x">{BODY}</div><div class="sidebar">Other, news, here</div></div></body>',
        f'<body><div class="notice-of-works"><div>{BODY}</div></div><div class="footer">Imprint</div></body>',
    ],
)
def test_pages_of_other_habits(page):
    assert main_text(page) == KEPT


def test_references_stay_and_menus_go():
    links = "".join(f'<li><a href="/{i}">Source {i}</a></li>' for i in range(3))
    page = f"<body><article>{BODY}<h2>Sources</h2><ul>{links}</ul></article></body>"
    assert main_text(page) == KEPT + "\n\nSources\n\n" + "\n\n".join(f"Source {i}" for i in range(3))
    page = f"<body><article><ul>{links}</ul>{BODY}</article></body>"
    assert main_text(page) == KEPT


def test_what_is_never_closed():
    assert main_text("<article><p>a > b</p><!-- c > d <p>e</p> f") == "a > b"
    assert main_text("<article><p>a</p> <![CDATA[b <c") == "a\n\nb <c"
    assert main_text("<article><p>a</p><!-- c") == "a"
    assert main_text("<article><p>a</p> 1 < 2 <b") == "a\n\n1 < 2 <b"


def test_long_comments_are_no_article():
    page = f'<body><div id="post">{BODY}</div><div class="comments">{BODY * 20}</div></body>'
    assert main_text(page) == KEPT
    form = f'<body><div id="post">{BODY}</div><form class="x"><p>Your name</p><textarea>t</textarea></form></body>'
    assert main_text(form) == KEPT


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 90_000 + "</section>" * 60_000 + BODY,
        "<ul>" + "<div>" * 60_000 + "<li>x" * 60_000,
        "<li><ul>" + "<div>" * 60_000 + "<li>x</li>" * 60_000,
        "<video>" * 100_000 + BODY,
        "<form>" * 100_000 + BODY,
        "<svg/>" * 100_000 + BODY,
        '<p>x</p><a "' * 3 + '<a "' * 250_000,
        "x > " + "<c " * 250_000,
        "<!--" * 200_000,
    ],
)
def test_a_megabyte_of_stray_tags_takes_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 8  # about one second; hundreds when it is quadratic
