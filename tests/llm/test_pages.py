import random
import re

import pytest
from conftest import SMALL

from textmill.llm.html_text import extract_text, lines, main_text, op6_html_text, runs

ARTICLE = "<p>First paragraph with a fair number of words in it, so that it weighs.</p><p>Second one, also with many words in it.</p>"
BODY = "First paragraph with a fair number of words in it, so that it weighs.\nSecond one, also with many words in it."

CASES = {
    "article": f"<body><nav><a href=x>menu</a></nav><article>{ARTICLE}</article><footer>end of page text</footer></body>",
    "main": f"<header><h1>Site name</h1></header><main>{ARTICLE}<aside>Side notes</aside></main>",
    "plain": f"<div class='menu'><a href=a>one</a> <a href=b>two</a></div><div>{ARTICLE}</div><div id=footer>imprint</div>",
    "links": f"<div><a href=a>Link one here</a> | <a href=b>Link two here</a></div><div>{ARTICLE}</div>",
    "comments": f"<article>{ARTICLE}<section class='comments'><article class='comment'><p>Nice text!</p></article></section></article>",
    "form": f"<main>{ARTICLE}<form><p>Write to us</p><input name=q><button>Go</button></form></main>",
    "notice": f"<div class='cookie-notice'>We use cookies</div><article>{ARTICLE}<div class='ad'>Buy this</div></article>",
    "script": f"<script>var a = '<p>no</p>';</script><article>{ARTICLE}<script>if (a < b) {{}}</script></article>",
    "hidden": f"<article>{ARTICLE}<p hidden>secret</p><p style='display: none'>gone</p></article>",
    "unclosed": "<article><p>First paragraph with a fair number of words in it, so that it weighs.<p>Second one, also with many words in it.",
    "comment": f"<article><!-- <p>old</p> -->{ARTICLE}<!-- open",
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_layouts(name):
    assert main_text(CASES[name]) == BODY


WRAPPED = {
    "layout": f"<div class='layout has-sidebar'><article>{ARTICLE}</article><div class='sidebar'>Side notes</div></div>",
    "page": f"<div id=page class='menu-open'><div class=menu>Menu</div>{ARTICLE}</div><footer>end</footer>",
    "section": f"<section class='social science'>{ARTICLE}</section><p>Imprint</p>",
    "inner": f"<main><div class='post share-bar'>{ARTICLE}</div><div class='comments'>{'<p>I agree.</p>' * 60}</div></main>",
    "open": f"<div class='single comments-open'>{ARTICLE}<ol id=comments><li>Nice text!</li></ol></div>",
    "long": f"<div class=has-sidebar><article>{ARTICLE}</article><div class=sidebar>{'<p>Side notes</p>' * 60}</div></div>",
    "related": f"<article>{ARTICLE}</article><section class='related'><article>One</article><article>Two</article></section>",
    "parts": "".join(f"<div class='widget widget-text'>{x}</div>" for x in ARTICLE.split("\n")),
}


@pytest.mark.parametrize("name", sorted(WRAPPED))
def test_names_of_wrappers(name):
    got = main_text(WRAPPED[name])
    assert BODY in got and "Side" not in got and "Menu" not in got and "agree" not in got and "One" not in got


COMMENT = "<div class='comment'><p>" + "I have much to say about this. " * 14 + "</p></div>"
TALKED = {
    "long": f"<div class=post><p>A short post on one thing.</p></div><div class=comments>{COMMENT * 10}</div>",
    "list": f"<div class=post><p>A short post on one thing.</p></div><ol class=commentlist><li>{COMMENT}</li></ol>",
    "status": f"<div class='single comments-open'><p>A short post on one thing.</p><div id=comments-area>{COMMENT}</div></div>",
    "ids": f"<div><p>A short post on one thing.</p></div><section id=disqus_thread>{COMMENT}</section>",
}


@pytest.mark.parametrize("name", sorted(TALKED))
def test_comments_longer_than_the_post(name):
    assert main_text(TALKED[name]) == "A short post on one thing."


def test_commentary_is_text():
    assert main_text(f"<div class=commentary>{ARTICLE}</div><p>Imprint</p>").startswith(BODY)
    assert main_text("<div class=comments><p>Nothing but comments here.</p></div>") == "Nothing but comments here."


def test_short_closing_remarks_and_link_paragraphs():
    items = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(5))
    page = f"<div>{ARTICLE}<ul>{items}</ul><p>A short closing remark.</p></div><ul>{items}</ul><p>(c) 2020 by us.</p>"
    assert main_text(page) == f"{BODY}\nA short closing remark."
    page = f"<div>{ARTICLE}<p><a href=r>See the full report of the study here.</a></p><p>And one more thing.</p></div>"
    assert main_text(page) == f"{BODY}\nSee the full report of the study here.\nAnd one more thing."
    teasers = "".join(f"<li><a href={i}>This is one more headline to click on.</a></li>" for i in range(5))
    assert main_text(f"<div>{ARTICLE}</div><ul>{teasers}</ul>") == BODY


def test_unbalanced_markup_takes_linear_time():
    import time

    for page in ("<b>" * 150_000 + "x" + "</i>" * 150_000, "<div><i>" * 60_000 + "x" + "</b></p>" * 60_000):
        start = time.perf_counter()
        assert main_text(page) == "x"
        assert time.perf_counter() - start < 5


def made_page(rng):
    """A page put together from known text and noise, and the text it must give."""
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    blocks = [words(rng.randint(12, 60)) + "." for _ in range(rng.randint(2, 9))]
    title = words(5)
    inner, want = [f"<h1>{title}</h1>"], [title]
    for b in blocks:
        cut = b.split(" ", 3)
        inner.append(f"<p>{cut[0]} <b>{cut[1]}</b>\n <a href=x>{cut[2]}</a> {cut[3]}" + rng.choice(["</p>", "", "</p>\n"]))
        want.append(b)
        if rng.random() < 0.3:
            inner.append(rng.choice([
                f"<script>{words(9)}</script>", f"<div class='ad-box'>{words(9)}</div>", f"<aside>{words(30)}</aside>",
                f"<form><label>{words(4)}</label><input></form>", f"<!-- {words(5)} -->", f"<style>p {{ {words(2)} }}</style>",
                f"<div class='share'><a href=y>{words(2)}</a></div>", f"<div role=alert>{words(12)}</div>",
            ]))
    around = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div class='post has-sidebar'>{}</div>"])
    links = "".join(f"<li><a href={i}>{words(2)}</a></li>" for i in range(rng.randint(2, 9)))
    before = rng.choice([f"<nav><ul>{links}</ul></nav>", f"<header><div>{words(3)}</div><ul>{links}</ul></header>", f"<ul class=menu>{links}</ul>"])
    after = [
        f"<footer><p>{words(20)}.</p></footer>", f"<div class='sidebar'><p>{words(25)}.</p></div>",
        f"<div id=comments><div class=comment><p>{words(rng.randint(5, 200))}.</p></div></div>",
        f"<div class='cookie-notice'>{words(15)}.</div>", f"<div class='related'><ul>{links}</ul></div>", f"<ul>{links}</ul>",
    ]
    rng.shuffle(after)
    return f"<html><body>{before}{around.format(''.join(inner))}{''.join(after[: rng.randint(0, 6)])}</body></html>", "\n".join(want)


def test_pages_of_known_text():
    rng = random.Random(11)
    for _ in range(400):
        page, want = made_page(rng)
        assert main_text(page) == want, page


def test_teasers_do_not_replace_the_text():
    cards = "".join(f"<article><h3>Teaser {i}</h3></article>" for i in range(3))
    assert BODY in main_text(f"<div id=content>{ARTICLE}</div><div>{cards}</div>")
    assert BODY in main_text(f"<div id=content>{ARTICLE}</div><div class='related'>{cards}</div>")


def test_a_long_block_does_not_hide_later_runs():
    gap = "<nav>a</nav>" * 4
    page = f"<div><p>{'long block ' * 2000}</p>{gap}{ARTICLE}{gap}<p>tiny</p></div>"
    assert main_text(page).endswith(BODY)


def test_references_and_white_space():
    page = "<article><p>a &amp; b&nbsp;&lt;c&gt; &eacute;&#233;&#x1F600;\n\t  d &bogus; <b>e</b>f</p><p> \n </p></article>"
    assert main_text(page) == "a & b <c> éé😀 d &bogus; ef"


def test_odd_pages():
    for page in (None, "", "   ", "<p", "<p>", "</p></p>", "<nav>only a menu</nav>", "<!-- x", "<script>x", "<a href='"):
        assert main_text(page) == ""
    assert main_text("just text") == "just text" and main_text("<") == "<"
    assert main_text("2 < 3 and 4 > 1") == "2 < 3 and 4 > 1"
    assert main_text('<article><p title="a > b">kept</p></article>') == "kept"
    assert main_text("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>") == "deep"


def test_surges_and_dives():
    assert runs([0, 0, 5, 9, 0, 0, 0, 0, 7, 0, 0, 0], 3) == [(2, 6, 14), (8, 11, 7)]
    assert runs([]) == [] and runs([0, 0]) == [] and runs([4]) == [(0, 1, 4)]


def test_a_long_page():
    page = "<article>" + "<p>some words</p>" * 50_000 + "</article>"
    assert main_text(page).count("\n") == 49_999


def test_all_pages(spark):
    import html

    rows = {r.page_id: r for r in op6_html_text(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p.html, re.S).group(1)
        blocks = [re.sub(r"<(?!br)[^>]*>", "", b).replace("<br>", " ") for b in re.split(r"</?(?:p|h1)>", inner)]
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert rows[p.page_id].text == "\n".join(b for b in want if b)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text) and rows[p.page_id].url == p.url


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, None, "t"), (1, CASES["main"], "t"), (1, CASES["main"], "t"), (None, "", None)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, html string, text string"), "html")
    assert got.columns == ["page_id", "text"]
    assert sorted(r.text for r in got.collect()) == ["", "", BODY, BODY]
    assert extract_text(spark.createDataFrame([], "page_id long, html string"), "html").count() == 0
    assert lines("<p>a</p>") == [("a", 0, False, False)]
