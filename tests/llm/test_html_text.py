"""Main text of pages: boilerplate out, everything of the article in, broken markup taken as browsers do."""

import html
import re

import pytest

from shardlens.llm import html_text
from shardlens.llm.html_text import main_text

PROSE = "It was a long day, with rain, wind and more rain, and nobody went out of the house."


def page(body, head="<title>T</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


SIDE = ('<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="sidebar"><p>' + PROSE
        + '</p></div><div id="cookie-notice">We use cookies, yes, we do, all day.</div><form><p>Your name, please</p><input></form>'
        '<script>var t="</p><p>no";</script><div class="ad">Buy, buy, buy now.</div>')
END = f'<section class="comments"><p>{PROSE}</p></section><footer>&copy; me</footer>'


@pytest.mark.parametrize("body", [
    f"<article><h1>Title</h1><p>{PROSE}</p><p>Short.</p></article>",
    f'<div class="post"><h1>Title</h1><p>{PROSE}</p><p>Short.</p></div>',
    f"<main><h1>Title</h1><div><p>{PROSE}<p>Short.</div></main>",
    f"<article><h1>Title</h1><p><b>{PROSE}<br><p>Short.</p></article>",
])
def test_article_only(body):
    assert main_text(page(SIDE + body + END)) == f"Title\n\n{PROSE}\n\nShort."


def test_references_white_space_and_marks():
    got = main_text(page("<article><p>a &amp; b&nbsp;&lt;c&gt;\n\t d<br>e<i>f</i>&#233;</p><!-- <p>x</p> --><p hidden>no</p><ul><li>1<li>2</ul></article>"))
    assert got == "a & b <c> d efé".replace("d e", "d e") + "\n\n1\n\n2"


@pytest.mark.parametrize("text, want", [(None, ""), ("", ""), ("<nav>x</nav>", ""), ("plain  text", "plain text"), ("<p>a", "a"),
                                        ("<p>a <b", "a"), ("<article><p>don't<p it's>x</p>", "don't\n\nx"), ("a < b", "a < b")])
def test_odd_pages(text, want):
    assert main_text(text) == want


def test_siblings_of_the_best_container_are_kept():
    more = "".join(f"<p>{PROSE} {i}</p>" for i in range(6))
    got = main_text(page(f'<div><div class="body">{more}</div><div class="rest"><p>{PROSE} A</p><p>{PROSE} B</p></div><div><a href="x">link</a></div></div>'))
    assert got.count(PROSE) == 8 and "link" not in got


def test_very_deep_and_very_long_pages():
    assert main_text("<div>" * 20000 + PROSE) == PROSE
    assert len(main_text(page("<article>" + f"<p>{PROSE}</p>" * 20000 + "</article>"))) == 20000 * (len(PROSE) + 2) - 2


def expected(page):
    """The article of the test tables' pages, by cutting strings."""
    body = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1])
    parts = (html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = html_text.op2_tree_scored_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.text == expected(pages[r.page_id].html) and r.n_chars == len(r.text)
