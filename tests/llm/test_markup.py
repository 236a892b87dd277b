"""Markup that holds no article text: every kind, on block and inline elements, and pages alone on their host."""

import pytest

from ledgerlark.llm import html_text


def zones(source):
    return {z: " | ".join(line for line, zone in html_text.lines(source) if zone == z) for z in (0, 1, 2)}


def test_declarations_are_no_text():
    assert html_text.lines("<!DOCTYPE html><html><body><p>open</p>") == [("open", 1)]
    assert html_text.lines("<?xml version='1.0'?><!ELEMENT a><![CDATA[x]]><p>t</p></>") == [("t", 1)]


def test_lone_page_has_no_doctype(spark):
    pages = [(1, "http://a.com/x", "<!DOCTYPE html><html><body><p>only &amp; open</p></body></html>"), (2, "http://b.com/x", "<!DOCTYPE html><article><p>a <button>b</button>c</p></article>")]
    found = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert [(r["text"], r["n_chars"]) for r in found.orderBy("page_id").collect()] == [("only & open", 11), ("a c", 3)]


@pytest.mark.parametrize("name", sorted(html_text.NOT_ARTICLE - {"map"}))
def test_elements_without_article_text(name):
    for place in ("<article><p>be{0}fore</p></article>", "<p>be{0}fore</p>"):
        seen = zones(place.format(f"<{name}>gone <i>too</i></{name}>"))
        inside = seen[2] or seen[1]
        assert "gone" not in inside and inside.replace(" | ", " ") in ("before", "be fore") and "gone too" in seen[0]


@pytest.mark.parametrize("word", sorted(html_text.BOILERPLATE))
@pytest.mark.parametrize("name", ["span", "a", "div", "section"])
def test_classes_without_article_text(name, word):
    for place in ("<article><p>first</p>{0}<p>last</p></article>", "<p>first</p>{0}<p>last</p>"):
        seen = zones(place.format(f"<{name} id=k class='x {word.title()}'>gone</{name}>"))
        assert (seen[2] or seen[1]) == "first | last" and seen[0] == "gone"


@pytest.mark.parametrize("attributes", ["hidden", "aria-hidden=true", "role='navigation'", 'role="dialog"', "class=comment-body", "class='reader-comments'", "class=newsletter-signup", "id=site-header"])
@pytest.mark.parametrize("name", ["span", "div"])
def test_attributes_without_article_text(name, attributes):
    assert zones(f"<article>first <{name} {attributes}>gone <p>too</p></{name}>last</article>")[2].replace(" | ", " ") == "first last"


def test_hidden_inline_elements_leave_the_line_whole():
    assert html_text.lines("<article><p>Hel<span class=ad>BUY <b>NOW</b></span>lo <span>kept</span></p></article>") == [("BUY NOW", 0), ("Hello kept", 2)]
    assert html_text.lines("<article><p>a<span class=ad>x<span>y</span>z</span>b</p></article>") == [("xyz", 0), ("ab", 2)]


def test_unclosed_hidden_inline_elements_end_with_their_block():
    assert html_text.lines("<article><p>a <span class=ad>bad</p><p>good</p></article>") == [("bad", 0), ("a", 2), ("good", 2)]
    assert html_text.lines("<article><div>a<label>bad<div>worse</div></div>good</article>") == [("bad", 0), ("worse", 0), ("a", 2), ("good", 2)]


def test_article_classes_that_only_sound_like_it():
    assert zones("<article class='has-comments'><div class='comments-open'>a</div><p class='share-price'>b</p><p id='related-work'>c</p></article>")[2] == "a | b | c"
