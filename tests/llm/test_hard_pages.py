"""Pages with broken or deep markup: whole text in time linear in the page."""

import time

import pytest

from quillgraph.llm import html_extract

BODY = ("This is some text of the page, with words and a stop at its end. " * 3).strip()
LONG = " ".join([BODY] * 3)


@pytest.mark.parametrize("page, least", [
    ("<a" * 5_000, 10_000), ("<a" * 200_000, 400_000), ("<!x" * 200_000, 0), ("<svg>" + "</svg " * 50_000, 0), ("<div>x" * 20_000, 0), ("<b>x" * 20_000, 20_000),
    ("<b>" * 20_000 + "x<p>y</p>" * 10_000, 0), ("<main>" * 20_000 + BODY, len(BODY)), ("<svg>" * 20_000 + BODY, len(BODY)),
    ("<ul>" + "<b>" * 10_000 + "<li>x" * 10_000, 0), ("<div>" * 20_000 + "</p></i>" * 20_000 + BODY, len(BODY)), ('<a "> "' * 40_000, 0),
    ("<a \"'>\"" * 40_000, 0), ("<b>" + "<i>" * 20_000 + "<div>" + "</b>" * 20_000 + BODY, len(BODY))])
def test_linear_time(page, least):
    began = time.process_time()
    assert len(html_extract.main_text(page)) >= least
    assert time.process_time() - began < 3


def test_twice_the_page_takes_about_twice_the_time():
    def cost(page):
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    for unit in ("<div>x", "<b>x", '<a "> "', "<ul><li>x"):
        assert cost(unit * 40_000) < 8 * cost(unit * 10_000) + 0.2


@pytest.mark.parametrize("name", "svg select object canvas audio video math template".split())
def test_skipped_elements_without_an_end(name):
    assert html_extract.main_text(f"<article><p>{BODY}</p><{name}><p>{BODY}</p></article>") == f"{BODY}\n{BODY}"
    assert html_extract.main_text(f"<article><p>{BODY}</p><{name}>inner</{name}><p>{BODY}</p></article>") == f"{BODY}\n{BODY}"


def test_scripts_without_an_end():
    assert html_extract.main_text(f"<article><p>{BODY}</p><script>let a = '<p>{BODY}</p>'") == BODY


@pytest.mark.parametrize("attrs", ['title="the hidden costs"', 'data-hidden="false"', 'data-role="navigation"', 'data-class="menu" data-id="footer"',
                                   "title='class=menu'", 'title="a > b"', "title=\"it's\""])
def test_attributes_by_whole_names(attrs):
    assert html_extract.main_text(f"<article><p {attrs}>{BODY}</p></article>") == BODY
    assert html_extract.main_text(f"<article><p>{BODY}</p><div {attrs}><p>{BODY}</p></div></article>") == f"{BODY}\n{BODY}"


def test_ambiguous_names_inside_an_article():
    part = f'<section id="discussion"><h2>Discussion of results</h2><p>{LONG}</p></section>'
    assert html_extract.main_text(f"<article><p>{BODY}</p>{part}</article>") == f"{BODY}\nDiscussion of results\n{LONG}"
    assert html_extract.main_text(f'<main><p>{BODY}</p><div class="legal-text"><p>{LONG}</p></div></main>') == f"{BODY}\n{LONG}"
    talk = f'<div id="discussion"><div class="comment"><p>{LONG}</p></div></div>'
    assert html_extract.main_text(f"<article><p>{BODY}</p>{talk}</article>") == BODY
    assert html_extract.main_text(f'<article><p>{BODY}</p></article><div id="discussion"><p>{LONG}</p></div>') == BODY
    linked = '<div class="related">' + "".join(f"<p><a href={i}>{BODY}</a></p>" for i in range(4)) + "</div>"
    assert html_extract.main_text(f"<article><p>{BODY}</p>{linked}</article>") == BODY


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, f"<p>{BODY}</p>", "old", 5, None)], "page_id bigint, html string, Text string, n_chars int, note string")
    out = html_extract.extract(pages)
    assert out.columns == ["page_id", "note", "text", "n_chars"]
    assert [tuple(r) for r in out.collect()] == [(1, None, BODY, len(BODY))]
