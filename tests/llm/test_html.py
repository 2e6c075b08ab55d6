import html as entities
import re
import time

import numpy as np
import pytest

from fablespark.llm import html_extract, queries
from fablespark.llm.html_extract import main_text

SHELL = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu entry</a></li></ul></nav>{}<footer>&copy; site</footer></body></html>'


def plain(html):
    """The generator's pages have one article of h1 and p blocks."""
    inner = re.search(r"<article>(.*?)(</article>|$)", html or "", re.S)
    if not inner:
        return ""
    blocks = re.split(r"</?(?:p|h1)>", inner[1])
    return "\n\n".join(x for x in (" ".join(entities.unescape(re.sub(r"<(?:br|/?b)>|<[^>]*$", " ", b)).split()) for b in blocks) if x)


def test_query_against_plain(spark, sf):
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op5_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert got == {p["page_id"]: (p["url"], plain(p["html"]), len(plain(p["html"]))) for p in pages}


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>Title</h1><p>First   para\n with <b>bold</b> text &amp; more.</p><p>No.</p></article>", "Title\n\nFirst para with bold text & more.\n\nNo."),
        ("<div class='ad'>Buy now, this is a long advert about many things.</div><article><p>Body &lt;here&gt;</p></article>", "Body <here>"),
        ("<main><p>Some text that is the main part of the page.</p><aside>Side</aside><div id='comments'><p>First reader comment!</p></div></main>", "Some text that is the main part of the page."),
        ("<div><p>" + "Long paragraph of real words. " * 9 + "</p><p>Short end.</p></div><div class='sidebar'><p>links</p></div>", ("Long paragraph of real words. " * 9).strip() + "\n\nShort end."),
        ("<form>Name <input></form><article><p>a<br>b<p>c<ul><li>one<li>two</ul></article>", "a b\n\nc\n\none\n\ntwo"),
        ("<nav>", ""),
        ("", ""),
    ],
)
def test_pages(body, want):
    assert main_text(SHELL.format(body)) == want


@pytest.mark.parametrize("html", [None, "", "<p", "&am", "<!-- open", "<article><p>cut &am", "<article><p>cut <a hr", "</p></div>", "plain"])
def test_broken_pages_do_not_fail(html):
    text = main_text(html)
    assert isinstance(text, str) and "<" not in text


def test_unclosed_menu_does_not_hide_the_article():
    assert main_text("<nav><ul><li>x<article><p>Words of the article.</p></article>") == "Words of the article."


PROSE = "Long paragraph of real words about one matter. " * 6


def test_votes_decide_on_pages_with_articles():
    cards = "".join(f"<article><h3><a href='/{i}'>Card {i}</a></h3><ul><li><a href='/{i}'>More</a></li></ul></article>" for i in range(4))
    assert main_text(SHELL.format(f"<main><h1>Title</h1><article><p>{PROSE}</p><p>{PROSE}</p><p>No.</p></article><p>{PROSE}</p>{cards}</main>")) == "\n\n".join(["Title", PROSE.strip(), PROSE.strip(), "No.", PROSE.strip()])
    assert main_text(SHELL.format(f"<div><p>{PROSE}</p><p>{PROSE}</p></div><div>{cards}</div>")) == f"{PROSE.strip()}\n\n{PROSE.strip()}"


def test_articles_outweigh_less_text_beside_them():
    assert main_text(SHELL.format(f"<div><p>{PROSE}</p></div><article><p>{PROSE}</p><p>End.</p></article>")) == f"{PROSE.strip()}\n\nEnd."


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<div><p>{PROSE}</p><blockquote>short quote</blockquote><section><p>short section</p></section></div>", [PROSE, "short quote", "short section"]),
        (f"<div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><h2>Part</h2><p>Shorter part.</p></div><div><p>{PROSE}</p></div><div><p>End.</p></div></div>", [PROSE, PROSE, "Part", "Shorter part.", PROSE, "End."]),
        (f"<div><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div><p>One.</p></div></div><div><ul><li><a href='/'>Link</a></li></ul></div>", [PROSE, PROSE, PROSE, "One."]),
        (f"<div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><ul><li><a href='/'>Link</a></li><li><a href='/2'>Link two</a></li></ul></div></div>", [PROSE, PROSE]),
        (f"<div><p>{PROSE}</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>1901</td><td>{PROSE}</td></tr></table></div>", [PROSE, "Year", "Sum", "1901", PROSE]),
        (f"<div><section><p>{PROSE}</p><blockquote><p>a</p><div>b</div></blockquote></section><section><section><p>c</p></section></section></div>", [PROSE, "a", "b", "c"]),
    ],
)
def test_nested_regions_without_article(body, want):
    assert main_text(SHELL.format(body)) == "\n\n".join(x.strip() for x in want)


CARDS = "".join(f"<{{0}}><h3><a href='/{i}'>Card {i}</a></h3><ul><li><a href='/{i}'>More</a></li></ul></{{0}}>" for i in range(4))


@pytest.mark.parametrize(
    "body",
    [
        f"<main><article><p>{PROSE}</p><p>{PROSE}</p></article>{CARDS.format('article')}</main>",
        f"<div><div><p>{PROSE}</p><p>{PROSE}</p></div></div>{CARDS.format('div')}",
        f"<div><p>{PROSE}</p></div><article><ul>{''.join(f'<li><a href=/{i}>Read</a></li>' for i in range(60))}</ul></article>",
    ],
)
def test_ratios_decide(monkeypatch, body):
    """Without the smoothed ratios the links and teasers beside the text come along, or take its place."""
    page, right = SHELL.format(body), main_text(SHELL.format(body))
    assert right in (PROSE.strip(), f"{PROSE.strip()}\n\n{PROSE.strip()}")
    monkeypatch.setattr(html_extract, "smoothed", lambda r: np.zeros(len(r)))
    assert main_text(page) != right
    monkeypatch.setattr(html_extract, "smoothed", lambda r: r.max() - r)
    assert main_text(page) != right


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<article><div class='post no-sidebar'><p>{PROSE}</p></div></article>", [PROSE]),
        (f"<div class='site-content has-sidebar'><p>{PROSE}</p><p>End.</p></div>", [PROSE, "End."]),
        (f"<div class='layout sidebar-right header-large'><p>{PROSE}</p><div class='sidebar'><p>Side text.</p></div><div id='siteFooter'>Foot</div></div>", [PROSE]),
        (f"<article><p>{PROSE}</p><div class='ad-slot'>Buy this.</div><p>End.</p></article>", [PROSE, "End."]),
        (f"<article><p>Short.</p></article><div class='comments-list'><p>{PROSE}</p><p>{PROSE}</p></div>", ["Short."]),
    ],
)
def test_names_of_layout_and_of_furniture(body, want):
    assert main_text(SHELL.format(body)) == "\n\n".join(x.strip() for x in want)


@pytest.mark.parametrize(
    "inside", ["<script>var x=1;</script>", "<style>p{}</style>", "<button>Press</button>", "<noscript>No script</noscript>", "<textarea>Type</textarea>", "<select><option>A</option><option>B</option></select>", '<span class="ad">BUY NOW</span>', "<svg><text>pic</text></svg>", '<span hidden>x</span>', "<select><option>A<option>B</select>"]
)
def test_what_is_dropped_inside_a_line(inside):
    assert main_text(SHELL.format(f"<article><p>Hello there {inside} world</p><p>Next.</p></article>")) == "Hello there world\n\nNext."
    assert main_text(SHELL.format(f"<div><p>{PROSE}{inside}</p><p>Next.</p></div>")) == f"{PROSE.strip()}\n\nNext."


@pytest.mark.parametrize("name", ["ad-box", "sidebar-right", "ad"])
@pytest.mark.parametrize("body", ["<article><p>Short article.</p></article>{}", "{}<main><p>Short article.</p></main>"])
def test_adverts_larger_than_the_article(name, body):
    assert main_text(SHELL.format(body.format(f"<div class='{name}'><p>{PROSE}</p><p>{PROSE}</p></div>"))) == "Short article."


def test_layout_names_without_an_article():
    assert main_text(SHELL.format(f"<div><p>{PROSE}</p></div><div class='sidebar-right'><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>")) == PROSE.strip()
    assert main_text(SHELL.format(f"<div class='sidebar-right'><p>{PROSE}</p><p>End.</p></div>")) == f"{PROSE.strip()}\n\nEnd."
    assert main_text(SHELL.format(f"<article><div class='post header-large'><p>{PROSE}</p><p>End.</p></div></article>")) == f"{PROSE.strip()}\n\nEnd."


def test_a_bracket_at_the_end_is_text():
    assert main_text("<article><p>we say x <") == "we say x <" and main_text("<") == "<"


def test_deep_nesting_takes_time_in_proportion():
    def took(n):
        page = "<div><span>" * n + "<p>text" + "</b></p>" * n + "<article><p>x</article>" + "</span></div>" * n
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    took(1000)
    assert took(16_000) < 8 * max(took(4000), 0.05)


def test_smoothing_keeps_the_mean():
    r = np.array([0.0, 0, 0, 0, 10, 0, 0, 0, 0])
    s = html_extract.smoothed(r)
    assert len(s) == len(r) and abs(s.sum() - 10) < 1e-9 and s.argmax() == 4


def test_odd_rows(spark):
    rows = [(1, None, None, "t", 1, "k"), (None, "u", "", None, None, None), (2, "u", "<article><p>x</p></article>", "t", 5, "k"), (2, "u", "<article><p>x</p></article>", "t", 5, "k"), (3, "u", "<article>" + "<p>long text here</p>" * 20000 + "</article>", "t", 1, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, `k.k` string")
    out = html_extract.extract_text(df)
    assert out.columns == ["page_id", "url", "k.k", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in out.collect()))
    assert got == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 20000 * 14 + 19999 * 2)]
    assert html_extract.extract_text(df.limit(0)).count() == 0
