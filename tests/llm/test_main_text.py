"""Main text of pages: made-up pages whose article is known, odd markup, and odd rows."""

import html
import random
import time

import pytest

from studyframe.llm import main_text
from studyframe.llm.main_text import Page, content_blocks

WORDS = "river stone light walk green table morning paper window garden letter bridge water summer".split()


def sentence(rnd, n):
    words = [rnd.choice(WORDS) for _ in range(n)]
    return " ".join(words).capitalize() + rnd.choice(".!?")


def paragraph(rnd):
    return " ".join(sentence(rnd, rnd.randint(5, 14)) for _ in range(rnd.randint(2, 6)))


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul></nav>'
AFTER = ('<section id="comments"><h2>Comments</h2><article class="comment"><p>First! A great read, thanks, really.</p></article></section>'
         '<form action="/x"><p>Leave a reply, please.</p><textarea>text</textarea><button>Send</button></form>')
ASIDE = '<aside><h3>More</h3><p>Other stories, of other days.</p></aside><div class="sidebar-right"><p>Weather: fine, all day long.</p></div>'
NOTICE = '<div id="cookie-notice">We use cookies, as you know. <a href="#">Fine</a></div><div class="ad">Buy now, pay later, be glad!</div>'
HEAD = ('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style>'
        '<script>var t="</p><article>no</article>";</script></head>')


@pytest.mark.parametrize("wrap", [
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div role="main"><div class="post">', "</div></div>"), ('<div class="c9">', "</div>"),
    ('<div id="content" class="with-sidebar no-ads"><section>', "</section></div>"), ('<table><tr><td class="story">', "</td></tr></table>")])
@pytest.mark.parametrize("closed", [True, False])
def test_article_of_made_pages(wrap, closed):
    rnd = random.Random(f"{wrap}{closed}")
    for _ in range(25):
        blocks = ["A heading & more"] + [paragraph(rnd) for _ in range(rnd.randint(3, 8))] + ["Short one.", paragraph(rnd)]
        body = f"<h1>{html.escape(blocks[0])}</h1>" + "".join(f"<p><b>{b[:5]}</b>{b[5:]}" + ("</p>" if closed else "\n<!-- c -->") for b in blocks[1:])
        page = f"{HEAD}<body class='has-sidebar'><header><h2>Site, of sites</h2></header>{NAV}{NOTICE}{wrap[0]}{body}{wrap[1]}{ASIDE}{AFTER}<footer>&copy; 2020, all of it.</footer></body></html>"
        assert main_text.main_text(page).split("\n\n") == blocks


def test_parts_inside_an_article_go():
    page = f"{HEAD}<body>{NAV}<article><header><h1>Title</h1></header>{NOTICE}<p>One, two.</p>{ASIDE}<p>Three <a href='x'>linked</a> four.</p>{AFTER}<footer>Filed under things.</footer></article>"
    assert main_text.main_text(page) == "Title\n\nOne, two.\n\nThree linked four."


def test_names_that_only_end_like_boilerplate_stay():
    page = "<article><div class='builder-widget builder-widget-text'><p>One, two.</p></div><div class='widget widget-tags'><p>Tags, tags.</p></div><div class='article-header'><p>By her, today.</p></div></article>"
    assert main_text.main_text(page) == "One, two.\n\nBy her, today."


def test_lists_tables_and_breaks():
    page = "<article><h2>A</h2><ul><li>one<li>two <i>2</i></ul><table><tr><td>x<td>y<tr><th>z</table><p>l1<br>l2<hr><dl><dt>t<dd>d</dl><pre>a\n  b</pre><blockquote>q</blockquote></article>"
    assert main_text.main_text(page).split("\n\n") == ["A", "one", "two 2", "x", "y", "z", "l1 l2", "t", "d", "a b", "q"]


def test_references_and_broken_markup():
    got = main_text.main_text("<article><p>a &lt;b&gt; &amp;amp; &eacute;&nbsp;&#x41; &unknown; 1 < 2 & 3</article>")
    assert got == "a <b> &amp; é A &unknown; 1 < 2 & 3"
    for page in ("<article><p>text</", "<article><p>text<!-- open", "<article><p>text<script>var x = 1", "<article><p>text</p></div></span></article></x>",
                 "<ARTICLE CLASS=Post><P>text</ARTICLE>", "<article><p>te<!-- > -->xt<![CDATA[]]></p>", "<article><p title=\"a>b\">text", "<article><p>text<!-->"):
        assert main_text.main_text(page) == "text", page
    assert main_text.main_text("<article><p>a <a href=\"never closed>b</a>") == "a b"
    assert main_text.main_text("plain text, no tags.") == "plain text, no tags."
    for page in ("", "<html></html>", "<!-- -->", NAV, "<nav>x", "<script>x</script>", "<article></article>", "<div hidden>gone, all of it.</div>"):
        assert main_text.main_text(page) == "", page


def test_ratios_choose_the_long_path():
    rnd = random.Random(3)
    texts = [paragraph(rnd) for _ in range(5)]
    page = Page("<div><p class=k>Menu</p><p class=k>Other</p></div><div>" + "".join(f"<p>{t}</p>" for t in texts) + "</div><div><p class=k>End</p></div>")
    assert [page.blocks[k][0] for k in content_blocks(page)] == texts
    ratios, smooth = main_text.path_scores(page)
    assert len(set(ratios[2:7])) == 1 and ratios[2] > 10 * ratios[0]
    assert smooth[0] < smooth[1] < smooth[4]


def test_time_follows_length():
    for part in ("<div>", "<b><p>", "<p>x</i>", "<li><ul>", "<table><td>", "</div>", "<a \"", "&amp", "<!", "<p class='", "<td></section>"):
        times = []
        for n in (4_000, 32_000):
            start = time.process_time()
            main_text.main_text("<section><article>" + part * n + "words, at last.")
            times.append(time.process_time() - start)
        assert times[1] < 40 * max(times[0], 0.01), part


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    long = "<article>" + "<p>some words, more of them.</p>" * 100_000 + "</article>"
    rows = [(1, "u", "<article><p>a  b</p></article>", "x", "x"), (1, "u", "<article><p>a  b</p></article>", "x", "x"), (2, None, None, None, None),
            (None, "v", "", "x", "x"), (3, "w", long, "x", "x")]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in main_text.extract_main_text(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, "u"] == ("a b", 3) and got[2, None] == ("", 0) and got[None, "v"] == ("", 0)
    assert got[3, "w"][1] == 100_000 * len("some words, more of them.") + 99_999 * 2
    assert main_text.extract_main_text(spark.createDataFrame(rows, schema)).count() == 5
    assert main_text.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
