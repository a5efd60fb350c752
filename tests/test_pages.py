"""Pages to runs of text: nesting, tails, missing end tags, references, and time that follows the length."""

import random
import re
import time

import pytest

from sheafline.sources import pages as pg


def runs(html):
    return [(tag, text.strip()) for tag, text in pg.page_runs(html) if text.strip()]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<div>first<p>in</p>tail</div>", [("div", "first"), ("p", "in"), ("div", "tail")]),
        ("<P>Up</P><H1 CLASS=x>Big</H1>", [("p", "Up"), ("h1", "Big")]),
        ("<p>a<br>b<br/>c</p>", [("p", "a b c")]),
        ("<p>x &amp; y &lt;b&gt; &eacute;&#33; &am &ampz</p>", [("p", "x & y <b> é! &am &z")]),
        ("<p>a&am<b>p;</b></p>", [("p", "a&amp;")]),  # a reference does not go over tags
        ("<p>one<p>two<div>three<li>four<li>five</div>six", [("p", "one"), ("p", "two"), ("div", "three"), ("li", "four"), ("li", "five")]),
        ("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>", [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("li", "e")]),
        ("<li>x<pre>y</pre>z</li>", [("li", "x"), ("li", "y"), ("li", "z")]),
        ("<pre>none</pre>bare</div></p><p>q", [("p", "q")]),
        ("<p>a<!-- <p>no</p> -->b<script>if (a<b) '<p>no</p>'</SCRIPT >c<style>p{}</style>d", [("p", "ab"), ("p", "c"), ("p", "d")]),
        ("<p title='a > b' x=\"</p>\" y>in</p>", [("p", "in")]),
        ("<p title=it's>in</p><p a=\"open>lost?</p>", [("p", "in"), ("p", "lost?")]),
        ("<p>1 < 2 <3 </ 4>5", [("p", "1 < 2 <3 5")]),
        ("<div/><p>a<hr>b</p><img src=x>c<p>d<img>e", [("p", "a"), ("p", "de")]),
        ("<p>cut <a href='", [("p", "cut")]),
        ("<script>never closed <p>x</p>", []),
        ("", []),
    ],
)
def test_runs(html, want):
    assert runs(html) == want


def slow_runs(html):
    """The same rules, searching the whole stack each time, for pages without quotes, scripts and comments."""
    stack, out, text = [], [], ""

    def flush():
        nonlocal text
        carrier = next((x for x in reversed(stack) if x in pg.PAGE_TAGS), None)
        if carrier and text.strip():
            out.append((carrier, text.strip()))
        text = ""

    for token in re.findall(r"<[^>]*>|[^<]+", html):
        if token[0] != "<":
            text += token
            continue
        name = token.strip("</>")
        if name in pg.INLINE_TAGS:
            text += " " if name == "br" else ""
            continue
        flush()
        if token[1] == "/":
            if name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
            continue
        if stack[-1:] == ["p"]:
            stack.pop()
        if name == "li":
            near = [i for i, x in enumerate(stack) if x in ("li", *pg.LISTS)]
            if near and stack[near[-1]] == "li":
                del stack[near[-1] :]
        if name not in pg.VOID_TAGS:
            stack.append(name)
    flush()
    return out


def test_runs_against_a_plain_stack():
    names = ["p", "li", "ul", "ol", "div", "h1", "title", "td", "b", "br", "hr", "footer"]
    for seed in range(400):
        r = random.Random(seed)
        html = "".join(r.choice([f"<{r.choice(names)}>", f"</{r.choice(names)}>", r.choice("xyz"), " "]) for _ in range(r.randint(0, 80)))
        assert runs(html) == slow_runs(html), html


@pytest.mark.parametrize(
    "html",
    [
        "<p>" + "<b>x</b>" * 50_000,
        "<x>t" * 50_000,
        "<div>t" * 50_000 + "</x>" * 50_000,
        "<p>" + "<" * 200_000,
        "<p>" + "<a b=\"" * 50_000,
        "<ul>" + "<x>" * 20_000 + "<li>t" * 20_000,
        "<p " + "a=1 " * 100_000 + ">t",
        "<p " + "=" + " " * 200_000,
        "<p>" + "<!--" * 50_000,
    ],
)
def test_time_follows_the_length(html):
    began = time.perf_counter()
    pg.page_runs(html)
    assert time.perf_counter() - began < 3


def test_pages_of_odd_kinds(spark):
    many = "<p>" + "<b>x</b> " * 50_000 + "</p>"
    rows = [(1, many), (None, "<p>a</p>"), (1, "<p>b"), (2, None), (3, ""), (4, "<p> </p><p>　c</p>")]
    got = pg.blocks_from_pages(spark.createDataFrame(rows, "page_id int, html string")).collect()
    assert sorted((str(r["page_id"]), r["line_no"], r["tag"], len(r["text"]), r["font_size"], r["weight"]) for r in got) == [
        ("1", 1, "p", 1, 12.0, 400), ("1", 1, "p", 99_999, 12.0, 400), ("4", 1, "p", 1, 12.0, 400), ("None", 1, "p", 1, 12.0, 400),
    ]
    assert pg.blocks_from_pages(spark.createDataFrame([], "page_id int, html string")).count() == 0
