"""Main text extraction: awkward pages, linear time, and held-out accuracy on given pages."""

import html
import os
import re
import time

import pytest

from ketspark.llm import html_extract as H

PAGES = "/root/testdata/sf0.1/pages.parquet"


def article(page):
    """Blocks of the article of a given page, by its template."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1] if m else "")
    texts = (" ".join(html.unescape(p.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split()) for p in parts)
    return "\n".join(t for t in texts if t)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test data")
def test_all_given_pages(spark):
    rows = H.extract(spark.read.parquet(PAGES)).select("html", "text").collect()
    assert len(rows) == 2500
    assert not [r for r in rows if article(r.html) != r.text]


@pytest.mark.parametrize("unit,end", [("<a ", ""), ('<p title="', ""), ('<p title="', ">"), ('<a ">" ', ""), ("<", ""), ("<!--", ">"), ("<script>", ""), ("</", ">"), ("<a \"'>", ""), ("<p class= ", ">"), ("&amp;", "")])
def test_broken_pages_take_linear_time(unit, end):
    page = unit * (1_000_000 // len(unit)) + end
    began = time.time()
    H.blocks(page)
    assert time.time() - began < 5


@pytest.mark.parametrize("first,then", [("<div>", "</section>"), ("<div>", "</p>"), ("<form>", "</form></ul>"), ("<section><p>", "</p></td>")])
def test_closing_tags_of_nothing_take_linear_time(first, then):
    n = 1_000_000 // len(first + then)
    began = time.time()
    H.blocks(first * n + then * n)
    assert time.time() - began < 5


@pytest.mark.parametrize("page", ['<body><form id="aspnetForm"><article><p>{}</p></article></form>', "<div class='content has-sidebar'><p>{}</p></div>", "<div class='page no-sidebar with-comments'><main><h1>{}</h1></main></div>", "<form><div><article><div><p>{}</p></div></article></div></form>"])
def test_what_is_around_a_text_does_not_hide_it(page):
    text = ("word " * 60).strip()
    assert H.main_text(page.format(text), H.grow(H.labelled_rows())) == text


def test_forms_and_sidebars_stay_out():
    tree, text = H.grow(H.labelled_rows()), "word " * 60
    for page in ("<body><form><p>{}</p></form>", "<article><form><p>{}</p></form></article>", "<aside><article><p>{}</p></article></aside>", "<div class='sidebar'><p>{}</p></div>"):
        assert H.main_text(page.format(text), tree) == "", page


def test_awkward_tables(spark):
    schema = "page_id long, url string, html string, text string, words int"
    good = "<body><nav><a href=/>home</a></nav><article><p>" + "word " * 30 + "</p></article></body>"
    rows = [(1, None, good, "old", 1), (1, None, good, "old", 1), (None, "u", None, None, None), (2, "u", "", "x", 0), (3, "u", good * 2000, "x", 0)]
    got = H.extract(spark.createDataFrame(rows, schema), out_col="text").collect()
    assert [r.text for r in got[:4]] == [("word " * 30).strip()] * 2 + ["", ""]
    assert got[4].text.count("word") == 60_000 and got[0].words == 1
    assert H.extract(spark.createDataFrame([], schema)).count() == 0


def test_names_around_an_article_say_nothing_about_it():
    tree = H.grow(H.labelled_rows())
    page = "<div class='content with-sidebar'><article><p>" + "word " * 40 + "</p><p>" + "more " * 40 + "</p><div class='share'>" + "tell " * 30 + "</div></article></div>"
    assert H.main_text(page, tree) == ("word " * 40).strip() + "\n" + ("more " * 40).strip()


def test_the_tree_asks_for_density_first():
    tree = H.grow(H.labelled_rows())
    assert tree[0] < H.COUNTED  # below the first split enclosing tags may be asked as well
