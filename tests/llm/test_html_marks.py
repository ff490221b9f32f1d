"""Both sides at once: usual boilerplate marks don't leak, and no part of an article is lost."""

import pytest

from helixmill.llm import html_text as H

SF = "/root/testdata/sf0.001"
MARKS = [f'class="{c}"' for c in (
    "site-footer post-comments comments-list user-comments reader-comment related-posts newsletter-signup ad-slot sponsored-content sidebar-left main-menu site-notice share-buttons "
    "page-header promo-box comment-form ads cookie-banner social_links breadcrumbs siteFooter popupOverlay widget-area advertisement"
).split()] + ['id="disqus_thread"', 'role="complementary"', 'role="contentinfo"', 'role="navigation"', "hidden", 'style="display: none"', 'class="comments open"']
A, B, N = "The first part of the article has some words in it. " * 4, "The second part goes on for a while, and ends here. " * 4, "Buy this thing now, said a reader who likes it. "
A, B, N = A.strip(), B.strip(), N.strip()


@pytest.fixture(scope="module")
def weights(spark):
    return H.learn(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div id="content">{}</div>', "<main>{}</main>", "{}"])
def test_marks_before_after_and_inside(weights, wrap):
    for mark in MARKS:
        for tag in ("div", "section", "ul"):
            for words in (N, f"{N} " * 12):
                noise = f"<{tag} {mark}><p>{words}</p><p>{words}</p></{tag}>" if tag != "ul" else f"<ul {mark}><li>{words}</li><li>{words}</li></ul>"
                for page in (noise + wrap.format(f"<h1>Title of it</h1><p>{A}</p><p>{B}</p>"), wrap.format(f"<h1>Title of it</h1><p>{A}</p><p>{B}</p>") + noise, wrap.format(f"<h1>Title of it</h1><p>{A}</p>{noise}<p>{B}</p>")):
                    assert H.main_text(f"<html><body>{page}</body></html>", weights) == f"Title of it\n{A}\n{B}", page


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>", "<main>{}</main>", "<section>{}</section>"])
@pytest.mark.parametrize("order", ["start", "middle", "end"])
def test_no_part_of_an_article_is_lost(weights, wrap, order):
    items = [f"item number {i} of the list" for i in range(12)]
    cells = [[f"cell {i} {j}" for j in range(3)] for i in range(4)]
    parts = {
        "list": ("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", items),
        "short list": ("<ol><li>one</li><li>two</li></ol>", ["one", "two"]),
        "divs": (f"<div>{A}</div><div><div>{B}</div></div>", [A, B]),
        "table": ("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells) + "</table>", [c for r in cells for c in r]),
        "quote": (f"<blockquote><p>{A}</p></blockquote>", [A]),
        "code": ("<pre><code>for x in y:\n    print(x)</code></pre>", ["for x in y: print(x)"]),
        "terms": ("<dl><dt>a term</dt><dd>its meaning in words</dd></dl>", ["a term", "its meaning in words"]),
        "figure": ("<figure><img src=x><figcaption>What the picture shows</figcaption></figure>", ["What the picture shows"]),
        "linked": (f'<p>See <a href="/x">this page</a> for what was said about it before.</p>', ["See this page for what was said about it before."]),
        "deep": ("<div><section><div><p>Deep down words stand here.</p></div></section></div>", ["Deep down words stand here."]),
        "heading": ("<h2>Comments on the law of 1901</h2><p>They were many.</p>", ["Comments on the law of 1901", "They were many."]),
    }
    for name, (markup, lines) in parts.items():
        pages = {"start": (f"<h1>T</h1>{markup}<p>{A}</p><p>{B}</p>", ["T", *lines, A, B]), "middle": (f"<h1>T</h1><p>{A}</p>{markup}<p>{B}</p>", ["T", A, *lines, B]), "end": (f"<h1>T</h1><p>{A}</p><p>{B}</p>{markup}", ["T", A, B, *lines])}
        page, want = pages[order]
        noise = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News of today</a></li></ul></nav>'
        got = H.main_text(f"<html><body>{noise}{wrap.format(page)}<footer>&copy; 2020</footer></body></html>", weights)
        assert got == "\n".join(want), (name, got)


def test_sections_that_a_heading_sets_apart(weights):
    for title in ("Comments", "3 Comments", "Leave a reply", "Related articles", "Reader comments (12)", "Share this", "Kommentare"):
        for page in (f"<article><h1>T</h1><p>{A}</p><section><h2>{title}</h2><p>{N}</p><p>{N}</p></section></article>", f"<article><h1>T</h1><p>{A}</p></article><section><h3>{title}</h3><p>{N}</p></section>", f"<div><h1>T</h1><p>{A}</p><h2>{title}</h2><p>{N}</p></div>"):
            assert H.main_text(f"<body>{page}</body>", weights) == f"T\n{A}", page
    again = f"<div><h1>T</h1><p>{A}</p><h3>Comments</h3><p>{N}</p><h2>Next chapter</h2><p>{B}</p></div>"
    assert H.main_text(again, weights) == f"T\n{A}\nNext chapter\n{B}"


def test_menus_of_links_without_marks(weights):
    menu = "<div>" + "".join(f'<div><a href="/{i}">Page number {i}</a></div>' for i in range(8)) + "</div>"
    assert H.main_text(f"<body>{menu}<div><h1>T</h1><p>{A}</p></div>{menu}<div>Copyright 2020, all rights reserved</div></body>", weights) == f"T\n{A}"


def test_names_by_their_words():
    for name in ("related-work", "form-of-government", "no-sidebar", "has-comments", "ad-free", "content", "post-header", "article-body", "advance", "radio", "headers-explained", "commentary", "share-of-the-market"):
        assert not H.boilerplate(name), name
    for name in ("Sidebar", "sidebar_left", "AdSlot", "comments2", "top-nav", "cookie-consent-box", "newsletterSignup"):
        assert H.boilerplate(name), name


def test_a_page_that_is_all_set_apart(weights):
    assert H.main_text(f'<body><div class="comments"><p>{A}</p></div></body>', weights) == A
    assert H.main_text(f'<body><form class="search"><p>{A}</p></form></body>', weights) == A
    assert H.main_text(f"<body><nav>{N}</nav></body>", weights) == ""


def test_repeated_and_null_ids_keep_the_bound(spark, monkeypatch):
    """Of 3000 rows with one page and one id, one is learned from; long names are told apart by all their signs."""
    seen = []
    page = f'<article><p>{A}</p></article><div class="{"x" * 200}1">{N * 3}</div>'
    pages = spark.range(3000).selectExpr("cast(null as long) as page_id", "'u' as url", f"'{page}' as html")
    weights = H.learn(pages, 10)
    assert weights["b:p"] == 1.0
    seen = [k for k in weights if k.startswith("n:")]
    assert len(seen) == 1 and len(seen[0]) < 60 and weights[seen[0]] < -3.3
    for last, kept in (("1", f"{A}"), ("2", f"{A}\n{N * 3}")):
        assert H.main_text(f'<div><p>{A}</p></div><div class="{"x" * 200}{last}">{N * 3}</div>', weights) == kept
