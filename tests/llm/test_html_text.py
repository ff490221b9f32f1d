import html
import re

import duckdb

from helixmill.llm import html_text as H

SF = "/root/testdata/sf0.001"


def reference(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
    return "\n".join(x for x in blocks if x)


def test_all_pages(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in H.query(spark, SF).collect()}
    rows = duckdb.connect().execute(f"select page_id, html from '{SF}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, page in rows:
        assert got[i] == (reference(page), len(reference(page)))


PAGE = """<!DOCTYPE html><html><head><title>T x</title><script>if (a<b) "</p>"</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">More links here</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main"><h1>A &amp; B</h1><p>First   paragraph with <b>some</b> words &lt;ok&gt;<p>Second<br>line of it &#233;</p><form><input><label>Mail</label></form>
<div class="comments"><p>I disagree with all of this, said a reader.</p></div></div><aside>About us</aside><footer>(c) all rights</footer></body></html>"""


def test_page_without_article():
    weights = {"t:nav": -3.0, "t:li": -3.0, "t:a": -2.0, "t:footer": -3.0, "b:p": 1.0, "b:h1": 1.0}
    assert H.main_text(PAGE, weights) == "A & B\nFirst paragraph with some words <ok>\nSecond line of it é"


def test_odd_rows(spark):
    rows = [(1, "u", None, 3), (None, None, "", 3), (2, "u", "<p>unclosed <b", 3), (2, "u", "<p>unclosed <b", 3), (3, "u", "<!-- x", 3), (4, "u", "plain words only", 3), (5, "u", "<p>" + "word " * 50000, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert got[1] == "" and got[None] == "" and got[3] == "" and got[4] == "plain words only" and len(got[5].split()) == 50000
    assert H.extract(pages.limit(0)).collect() == []


def test_articles_in_other_elements(spark):
    """Weights of pages with <article> serve pages where it is a div: the text is the same."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = H.learn(pages)
    bad = 0
    for r in pages.collect():
        for tag in ("div", "section", 'div class="post-body"'):
            page = r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")
            bad += H.main_text(page, weights) != reference(r.html)
    assert bad == 0, bad


BODY = "<p>" + "One sentence of the article after another. " * 8 + "</p>"
TEXT = ("One sentence of the article after another. " * 8).strip()


def test_names_that_only_look_like_boilerplate(spark):
    weights = H.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    for page in (
        f'<html><body class="page has-sidebar">{BODY}</body></html>', f'<html><body class="no-sidebar">{BODY}</body></html>',
        f'<html class="no-js cookies"><body>{BODY}</body></html>', f'<body><form action="/">{BODY}</form></body>', f'<div class="ad-free content">{BODY}</div>',
        f'<div class="related-work">{BODY}</div>', f'<article class="post comments">{BODY}</article>', f'<main id="search">{BODY}</main>',
    ):
        assert H.main_text(page, weights) == TEXT, page
    inner = f'<article>{BODY}<div id="form-of-government">{BODY}</div><div class="advert">{BODY}</div>{BODY}</article>'
    assert H.main_text(inner, weights) == "\n".join([TEXT] * 3)
    assert H.main_text(f"<p title=it's>{BODY[3:]}", weights) == TEXT


def test_broken_markup_takes_linear_time():
    import time

    for piece in ('<a "', "<a x='", '<a x="', "<!", "<b", "<p =", "<!--"):
        began = time.process_time()
        H.main_text("text " + piece * 20000, {})
        H.main_text("text " + piece * 20000 + ">", {})
        assert time.process_time() - began < 3, piece
