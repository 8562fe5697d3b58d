"""Operator 6: planted pages and a plain reading of the test tables."""

import html
import re
import time

from revsift.llm.html_text import extract_pages, main_text
from revsift.llm.queries import op6_main_text

from .conftest import MEDIUM, rows_by

LONG = "This is a sentence of the article, with commas, and it is long enough to matter. " * 3


def text(page):
    return main_text(page)[0]


def test_query_matches_a_plain_reading(spark):
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()
    got = rows_by(op6_main_text(spark, MEDIUM), "page_id")
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)
        assert got[p["page_id"]]["url"] == p["url"]


def test_page_without_article_element():
    page = f"""<html><body><header><h1>Site</h1></header><ul class=menu><li><a href=/>Home</a></ul>
    <div id=content><div class="sidebar"><p>{LONG}</p></div><div class=post-body><h2>Title</h2><p>{LONG}<p>Short.<ul><li>one<li>two
    </ul><table><tr><td>c1<td>c2</table></div><div class="cookie-notice">We use cookies.</div><div class=comments><p>{LONG}</p></div></div>
    <form><p>Name</p></form><footer>c</footer>"""
    assert text(page) == " ".join(f"Title {LONG} Short. one two c1 c2".split())


def test_title_and_lead_beside_a_long_body():
    for times in (1, 10, 100):
        body = f"<p>{LONG}</p>" * times
        page = f"""<body><div class=top><a href=/>Home</a></div><div class=post><h1>Title</h1><div class=intro><p>A short lead.</p></div>
        <div class=gap>By someone</div><div class=when>Today</div><div class=entry-content>{body}</div></div>
        <div class=more><h3>Elsewhere</h3><ul><li><a href=/a>Other story</a></ul></div></body>"""
        assert text(page) == " ".join(f"Title A short lead. By someone Today {LONG * times}".split()), times


def test_what_is_never_the_article():
    for junk in ("<nav><p>{0}</p></nav>", "<aside><p>{0}</p></aside>", "<div class='ad'><p>{0}</p></div>", "<form><p>{0}</p></form>",
                 "<section id=comments><p>{0}</p></section>", "<script>{0}</script>", "<style>{0}</style>", "<!-- {0} -->",
                 "<div role=complementary><p>{0}</p></div>", "<noscript>{0}</noscript>", "<div hidden>{0}</div>",
                 "<div class='newsletter-signup'>{0}</div>", "<header><p>{0}</p></header>", "<div style='display: none'>{0}</div>"):
        page = f"<body>{junk.format('JUNK words, many of them, here. ' * 5)}<article><h1>T</h1><p>{LONG}</p></article></body>"
        assert text(page) == "T " + LONG.strip(), junk
        inside = f"<body><article><h1>T</h1><p>{LONG}</p>{junk.format('JUNK words, many.')}</article></body>"
        assert text(inside) == "T " + LONG.strip(), junk


def test_words_that_only_hint():
    for part in ("<section id='discussion'>{0}</section>", "<div id='search-methods'>{0}</div>", "<div class='copyright'>{0}</div>",
                 "<h2 id='related-work'>Work</h2>{0}", "<h3 id='social-history'>History</h3>{0}", "<section id='ad-hoc-networks'>{0}</section>"):
        part = part.format(f"<p>{LONG}</p>")
        want = "T " + LONG.strip() + (" Work" if "Work" in part else " History" if "History" in part else "") + " " + LONG.strip()
        assert text(f"<body><article><h1>T</h1><p>{LONG}</p>{part}</article></body>") == want, part
    links = "<a href=/1>Another story</a> <a href=/2>And one more, to read next, today.</a>"
    for junk in (f"<div class='related'><p>{links}</p></div>", "<div class=social>Follow us</div>", "<p><a class=share href=/>Share</a></p>"):
        assert text(f"<body><article><p>{LONG}</p>{junk}</article></body>") == LONG.strip(), junk
    notice = "<div class=notice><p>We use cookies to show you this page. Read on to agree with that.</p></div>"
    assert text(f"<body>{notice}<div class=text><h1>T</h1><p>{LONG}</p></div></body>") == "T " + LONG.strip()
    assert text("<article><p>A <span class=search>search</span>ed word.</p></article>") == "A searched word."


def test_formulas_stay():
    page = "<article><p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x = 2</annotation></semantics></math> holds.</p></article>"
    assert text(page) == "So x=2 holds."


def test_references_white_space_and_broken_markup():
    assert text("<article><p>a &amp;&lt;&#233;&#x4e2d;&nbsp;b\n\t c</p><p>x<b>y</b>z<br>w</article>") == "a &<é中 b c xyz w"
    assert text("<article><p>1 < 2 <3 and <b>open <p>next</b> <i>it") == "1 < 2 <3 and open next it"
    assert text("<article><p>cut off <b>here") == "cut off here"
    assert text("plain text, no tags") == "plain text, no tags"
    assert text("<p>" * 300 + LONG) == LONG.strip()


def test_edges(spark):
    rows = [(1, "u", None, 1), (None, None, "", 2), (3, "v", "<p>same words</p>", 3), (3, "v", "<p>same words</p>", 3),
            (4, "w", f"<article><p>{LONG * 3000}</p></article>", 5), (5, "x", "<script>only</script>", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(extract_pages(df).collect(), key=lambda r: (r["page_id"] or 0))
    assert [r["text"][:10] for r in got] == ["", "", "same words", "same words", LONG[:10], ""]
    assert got[4]["n_chars"] == len((LONG * 3000).strip())
    assert extract_pages(df.limit(0)).count() == 0


def test_notices_with_sentences_go():
    said = "We use cookies on this site to show you what you like. Read on to agree with that."
    for junk in ("<div class='cookie-banner'><p>{0}</p></div>", "<div id='cookie-notice'>{0}</div>", "<div class=related><p>{0}</p></div>",
                 "<section class='related-posts'><p>{0}</p></section>", "<div class='newsletter'><p>{0}</p></div>", "<div class=notice>{0}</div>",
                 "<div class='popup overlay'><p>{0}</p></div>", "<div class='promo-box'><p>{0}</p></div>", "<article class='comment'><p>{0}</p></article>"):
        for times in (1, 20):
            box = junk.format(" ".join([said] * times))
            for page in (f"<body>{box}<article><h1>T</h1><p>{LONG}</p></article></body>", f"<body><main><h1>T</h1><p>{LONG}</p>{box}</main></body>",
                         f"<article><h1>T</h1>{box}<p>{LONG}</p></article>"):
                assert text(page) == "T " + LONG.strip(), page
    # a wrapper around the whole page is not a notice
    assert text(f"<div class='overlay'><article><h1>T</h1><p>{LONG}</p></article></div>") == "T " + LONG.strip()
    assert text(f"<div class='page-banner widget'><div><h1>T</h1><p>{LONG}</p></div></div>") == "T " + LONG.strip()


def test_several_articles_stay_together():
    page = f"<body><nav>x</nav><article><h2>A</h2><p>{LONG * 2}</p></article><article><h2>B</h2><p>{LONG}</p></article><footer>f</footer></body>"
    assert text(page) == f"A {LONG * 2}".strip() + f" B {LONG}".rstrip()
    teaser = "<article><h3><a href=/1>Other story</a></h3><p>Read.</p></article>"
    assert text(f"<body><article><h2>A</h2><p>{LONG}</p></article>{teaser}</body>") == f"A {LONG}".strip()


def test_depth_costs_no_more_than_length():
    for tags in ("<div>", "<div class=a>", "<div class=related>", "<b>", "<li>", "<p><table><td>", "<ul><li>"):
        page = tags * 100_000 + f"<p>{LONG}</p><p>End.</p>"
        began = time.monotonic()
        assert text(page) == f"{LONG}End.", tags
        assert time.monotonic() - began < 10, tags
