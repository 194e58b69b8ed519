"""Page extraction: broken markup, time in proportion to length, and pages on which density alone can decide."""

import re
import time

import pytest

from basewatch.llm import html_text
from basewatch.llm.common import table

SF = "/root/testdata/sf0.01"
BROKEN = {
    "<p>hello</p><![foo[bar]]><p>x</p>": "hello\nx", "<![ x": "", "<p>a<!doctype x><?php y ?><p>b</p>": "a\nb", "<p>a</><p>b</p 'x>": "a\nb", "<p>1 < 2 <3 & 4 &lt; 5</p>": "1 < 2 <3 & 4 < 5", "<p>a<!-->b<!--->c<!-- x --!>d<!-- -- > -->e</p>": "abcde",
    "<p>a</p><p class='x": "a", "<p>a</p><!-- never ends": "a", "<p>a</p><script>never </p> ends": "a", "<p title='a>b' hidden=\"\">x</p><p>y</p>": "y", "<P>A<BR/>b</P>": "A b", "a</b></i>b": "ab", "<p>a<!x": "a", "<": "<", "</": "</", "<a": "", "text<br": "text",
}


@pytest.mark.parametrize("html", sorted(BROKEN))
def test_broken_markup(html):
    assert html_text.main_text(html) == BROKEN[html]


LONG = {
    "unfinished tags": "<a " * 350_000, "comments": "<!--" * 250_000, "short comments": "<p>x</p><!--a-->" * 60_000, "declarations": "<![x" * 250_000, "nested inline": "<p>" + "<b>" * 60_000 + "x", "ends that match nothing": "<p>" + "<i>" * 30_000 + "</b>" * 30_000 + "t",
    "blocks below inline": "<span>" * 20_000 + "<div>a</div>" * 20_000, "quotes": "<p class='" * 100_000, "one paragraph": "<div><p>" + "word " * 200_000 + "</p></div>", "ampersands": "&" * 500_000, "titled articles": "<article><h1>t</h1>" * 5_000 + "<div class=sidebar>" + "x " * 9_000,
    "noise in a name": '<div class="' + "ad-" * 300_000 + '">x</div>', "scripts": "<script>" * 120_000, "deep": "<div>" * 50_000 + "x", "cells": "<table><tr>" * 5_000 + "<td>x" * 20_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_pages_take_time_in_proportion(name):
    began = time.time()
    html_text.main_text(LONG[name])
    assert time.time() - began < 5


def altered(html):
    """Without article elements and without classes, ids and roles."""
    return re.sub(r"(</?)article\b", r"\1div", re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", html))


def test_density_decides_where_names_say_nothing(spark, monkeypatch):
    pages = [r.html for r in table(spark, SF, "pages").select("html").collect()]
    named = [html_text.main_text(h) for h in pages]
    got = [html_text.main_text(altered(h)) for h in pages]
    lines = lambda t: t.split("\n")
    assert all(set(lines(a)) <= set(lines(b)) for a, b in zip(named, got, strict=True))  # nothing of the article is lost
    assert sum(a == b for a, b in zip(named, got, strict=True)) >= 0.95 * len(pages)
    monkeypatch.setattr(html_text, "_density", lambda n, share: 1.0 if n.chars else 0.0)
    assert sum(html_text.main_text(altered(h)) != b for h, b in zip(pages, got, strict=True)) >= 0.9 * len(pages)


def test_pages_with_other_columns_and_none(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>a"), (2, "v", "<![ x"), (2, "v", "<![ x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS text", "1 AS n_chars")
    assert sorted(map(str, html_text.extract(df).collect())) == sorted(["Row(page_id=1, url='u', text='', n_chars=0)"] * 2 + ["Row(page_id=None, url=None, text='a', n_chars=1)"] + ["Row(page_id=2, url='v', text='', n_chars=0)"] * 2)
    assert html_text.extract(df.limit(0)).count() == 0
