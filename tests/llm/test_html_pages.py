"""Visibility, spans and line breaks, time in proportion to hostile pages, and an independent plain renderer."""

import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import html


@pytest.mark.parametrize(
    "page, want",
    [
        ("a<br><br>b", "a\n\nb"), ("a<br>b<br>", "a\nb"), ("<p>a</p><br><p>b</p>", "a\n\nb"), ("a<br><br><br>b", "a\n\n\nb"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"), ("<i style='visibility:collapse'>a</i>b", "b"),
        ("<div style='display:none'>a<b style='visibility:visible'>b</b></div>c", "c"), ("<p style='visibility:hidden'>a<p>b", "b"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"), ("<table><tr><td>a<td rowspan=2>bb<td>c<tr><td>d<td>e</table>", "a  bb  c\nd      e"),
        ("<table><tr><td rowspan=0>r<td>1<tr><td>2<tr><td>3</table>", "r  1\n   2\n   3"), ("<table><tbody><tr><td rowspan=9>r<td>1<tbody><tr><td>2<td>3</table>", "r  1\n2  3"),
        ("<table><tr><td style='visibility:hidden'>xx<td>y<tr><td>a<td>b</table>", "   y\na  b"),
        ("<table><tr><td>漢字<td>x<tr><td>abcd<td>y<tr><td>é<td>z</table>", "漢字  x\nabcd  y\né     z"),
        ("<textarea>\n a\n  b</textarea>", " a\n  b"), ("<pre>\nx\n y</pre>", "x\n y"),
        ("<!-->a<!--->b<!-- x --!>c", "abc"), ("a<b c=\"d>e", "ae"), ("a<b c='d\">e</b> f", "ae f"), ("1 < 2 <3 <", "1 < 2 <3 <"), ("</>a</ b>c<?x?>d<!y>e", "acde"), ("<a b=c/>d", "d"), ("<a b>c</a d='>'>e", "ce"),
        ("<p>a<table><tr><td><p>b</table>c", "a\n\nb\n\nc"), ("<ul><li>a<div>b<li>c</ul>", "- a\n  b\n- c"), ("<head><title>t</title><p>x", "x"),
    ],
)
def test_pages(page, want):
    assert html.page_text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350000 + '"', "<div>" * 200000 + "x", "<b>" * 170000 + "</p>" * 120000, "<a b='>" * 150000, "<a b=\">" + "<a c='>" * 140000 + "x", "<!-- -" * 160000, "<!--x-->" * 120000,
        "<ul><li>x" * 110000, "<table><tr><td>x" * 60000, "<table><tr>" + "<td>x" * 200000, "<table>" + "<tr><td rowspan=9 colspan=2>x<td>y" * 30000, "<p>x" * 250000, "</b>" * 250000, "&lt" * 300000,
        "<script>" * 120000, "<td>x" * 200000, "<blockquote>a" * 80000, "<select>" + "<option>x" * 100000,
    ],
    ids=lambda p: p[:14],
)
def test_a_megabyte_of_hostile_markup(page):
    t = time.process_time()
    html.page_text(page)
    assert time.process_time() - t < 8


class Plain(HTMLParser):
    """Words of all visible text, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words = [], Counter()

    def handle_starttag(self, tag, attrs):
        if tag in html.VOID:
            self.words.update([])
            return
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        if self.hidden or tag in html.INVISIBLE or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.words.update(data.split())


def test_same_words_as_a_plain_renderer(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    assert len(pages) > 100
    for r in pages:
        p = Plain()
        p.feed(r.html or "")
        p.close()
        got = Counter(x for x in html.page_text(r.html or "").split() if x not in ("-", "|"))
        want = Counter({k: n for k, n in p.words.items() if k not in ("-", "|")})
        assert "".join(sorted("".join(got.elements()))) == "".join(sorted("".join(want.elements()))) or got == want, r.page_id


def test_rows(spark):
    long = "<p>" + "word " * 200000
    pages = spark.createDataFrame([("a", "<p>x", 1), ("a", "<p>x", 2), (None, None, 3), ("b", long, 4), ("c", "", 5)], "page_id string, html string, text long")
    got = sorted(((r.page_id or "", len(r.text)) for r in html.extract(pages).collect()))
    assert got == [("", 0), ("a", 1), ("a", 1), ("b", 999999), ("c", 0)]
    assert html.extract(pages.filter(F.lit(False))).count() == 0
