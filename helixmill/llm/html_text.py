"""Operator 1, HTML extraction: the maximum-scoring contiguous run of a page's tokens.

A page is a sequence of tokens, words and tags. Words score positive, by the tag of their block; tags
score negative. Weights come from labelled pages: pages that mark their article with exactly one
``<article>`` say which tokens are content. The tags before a block take at most four fifths of what its
words give, so a list, a table or a nest of elements never costs an article its end. One linear scan
per page finds the contiguous run with the largest sum; the blocks that it touches are the text, but for
those inside that are set apart.

Set apart are words that no reader takes for the article, and they score negative as tags do:

* in scripts, styles, navigation, page headers, footers, asides, forms, hidden elements, and elements whose role says so;
* in elements with a class or id name that is learned (per tag and name) to stand outside articles, or, if
  it wasn't seen, that is made of words for boilerplate and of words that only say where or what kind of box
  it is (``post-comments``, ``sidebar-left``), without a word that negates it (``no-sidebar``) or any other
  (``related-work``). Names of html, body, main and article never set apart;
* after a heading such as "Comments", until its element ends or a heading of its rank follows;
* outside of ``article`` and ``main``, where these hold most of the page's words.

Blocks that are links for the most part score negative, and so do short ones outside of articles and paragraphs that
speak of copyright, subscriptions and the like: inside of a run they stay, at its ends they don't. If all words of a page
are set apart, names and headings are left out of account, and then forms as well.

Weights are counted on at most ``train_pages`` distinct pages (those with the smallest hash), as sums by feature; the
``features`` most frequent are kept. Each page is scanned whole.

Rows: a null or empty html has the empty text; repeated rows are treated alike; ids and urls pass
through as they are, null or not; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head title script style noscript template nav header footer aside form button select option textarea input iframe object svg canvas menu dialog".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# fixed values: words of names. What is boilerplate, what only says where or what kind of box, and what negates
BOILER = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog disqus disclaimer "
    "feedback footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification optin outbrain overlay pager pagination pingback "
    "pingbacks popular popup promo promos promotion promotions recommended recommendation recommendations register related replies reply respond responses search share sharing "
    "sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription taboola toolbar trackback trackbacks trending widget widgets".split()
)
BOXES = frozenset(
    "a accept all and area article articles bar block blocks body bottom box btn button buttons center col column container content count desktop div dropdown entry fixed form global "
    "grid group holder icon icons id in inner inline item items js large layer left link links list main message messages mobile module more new news outer page pages panel parent policy post posts "
    "primary reader readers region right row second secondary section shell short side site slot small sticky stories story tab text the thread tile title to top unit user users view wrap wrapper zone".split()
)
NEGATES = frozenset("no not non without with has free off disabled".split())
OWN_HEADER = frozenset("article post entry content section story".split())  # a header of these holds a heading
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert form".split())
HEADINGS = re.compile(
    r"\W*(?:\d+\W+)?(?:(?:reader|user|post|view|all|latest|recent|leave|add|write|post|join|your|a|the|\d+|this|us|more|you)\W+)*"
    r"(?:comments?|responses?|replies|reply|discussion|related(?:\W+(?:articles?|posts?|stories|links|content|reading))?|recommended(?:\W+for you)?|share|follow|subscribe|newsletter|advertisement|sponsored|"
    r"kommentare?|commentaires?|comentarios?)(?:\W+(?:this|us|a|to|the|on|for|you|\d+|here|below|policy|closed|are))*\W*",
    re.I,
)
EDGES = re.compile(r"\xa9|\(c\)\s|copyright|all rights reserved|privacy policy|terms of (?:use|service)|cookie|subscribe|newsletter|sign ?up|log ?in|powered by|follow us|share (?:this|on)|advertisement|sponsored", re.I)

PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
WHOLE = frozenset("html body main article".split())

# a quote opens a value only after an equals sign; nothing is tried twice
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/><]*+)((?>[^<>=]|=\s*+(?>\"[^\"]*\"|'[^']*')?)*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RANK = {f"h{i}": i for i in range(1, 7)}

FORM, NAMED, TAGGED = 1, 2, 3  # what sets a token apart; the larger counts
APART, LINKS, EDGE = -2.0, -1.0, -1.0  # what a block scores that is set apart, is made of links, or looks like a page's edge
LEAST = 0.2  # the share of a block's words that tags leave


def boilerplate(name: str) -> bool:
    """Whether a name that was never seen says that an element isn't content."""
    words = [w.lower() for w in _WORDS.findall(name)]
    told = [w for w in words if w in BOILER]
    if not told or NEGATES.intersection(words) or not all(w in BOILER or w in BOXES for w in words):
        return False
    return not (set(told) == {"header"} and OWN_HEADER.intersection(words))


def _feature(tag: str, name: str) -> str:
    """A name's feature; long names stand by their digest."""
    key = f"n:{tag}.{name.lower()}"
    return key if len(key) <= 96 else f"n:{hashlib.sha1(key.encode('utf-8', 'surrogatepass')).hexdigest()}"


class _Element:
    __slots__ = ("tag", "block", "names", "article", "apart", "link", "rest", "rank")

    def __init__(self, tag, block, names, article, apart, link):
        self.tag, self.block, self.names, self.article, self.apart, self.link = tag, block, names, article, apart, link
        self.rest, self.rank = 0, 0  # set apart from a heading on, and that heading's rank


def tokens(page: str, weights: dict[str, float] | None = None):
    """(kind, name or text, element) for each tag ('<') and run of text ('w'); the element says what stands around it."""
    stack = [_Element("", "", (), False, 0, False)]
    at, last = 0, page.rfind(">") + 1
    heading: list[str] | None = None
    within: list[_Element] = []  # the heading's elements
    told: dict[str, bool] = {}

    def named(tag, name):
        key = _feature(tag, name)
        if key not in told:
            odds = (weights or {}).get(key)
            told[key] = odds < 0 if odds is not None else boilerplate(name)
        return told[key]

    def closing(names):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag not in INLINE:
                return

    for m in _TOKEN.finditer(page, 0, last):
        if m.start() > at:
            text = page[at : m.start()]
            if heading is not None:
                heading.append(text)
            yield ("w", text, stack[-1])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            apart = tag in _RANK and heading is not None and sum(map(len, heading)) < 200 and HEADINGS.fullmatch(entities.unescape("".join(heading)).strip())
            for e in within if apart else ():
                e.apart = max(e.apart, NAMED)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    yield ("<", "/" + tag, stack[k])
                    del stack[k:]
                    break
            else:
                yield ("<", "/" + tag, stack[-1])
            if apart:
                stack[-1].rest, stack[-1].rank = NAMED, _RANK[tag]
            if tag in _RANK:
                heading, within = None, []
            continue
        if tag in CLOSES_P:
            closing(("p",))
        if tag in SELF_CLOSING:
            closing(SELF_CLOSING[tag])
        around = stack[-1]
        if tag in _RANK:
            heading, within = [], []
            if around.rest and _RANK[tag] <= around.rank:
                around.rest = 0
        names, apart, article = around.names, max(around.apart, around.rest), around.article
        attributes = m[4] or ""
        if tag not in WHOLE and tag not in INLINE and attributes:
            for kind, value in _NAMES.findall(attributes):
                for name in value.strip("\"'").split():
                    if kind.lower() == "role":
                        apart = max(apart, TAGGED if name.lower() in ROLES else 0)
                        article = article or name.lower() in ("main", "article")
                    elif apart < NAMED:
                        apart = NAMED if named(tag, name) else apart
                    if weights is None:
                        names = (*names, _feature(tag, name))
            if _HIDDEN.search(attributes):
                apart = TAGGED
        block = around.block if tag in INLINE else "" if tag == "article" else tag
        # a header inside the article may hold its heading; a page's header doesn't
        if tag in NEVER and not (tag == "header" and article):
            apart = max(apart, FORM if tag == "form" else TAGGED)
        article = article or tag in ("article", "main")
        element = _Element(tag, block, names, article, apart, around.link or tag == "a")
        if heading is not None:
            within.append(element)
        yield ("<", tag, element)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(element)
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that is never closed ends the text
        yield ("w", rest[: cut.start()] if cut else rest, stack[-1])


def _features(batches):
    """(feature, inside, outside) sums over the labelled pages of a partition."""
    sums: dict[str, list[int]] = {}
    for b in batches:
        for page in b.column(0).to_pylist():
            if not page or len(re.findall(r"<article\b", page, re.I)) != 1:
                continue
            for kind, text, e in tokens(page):
                if kind == "<" and text.strip("/") == "article":
                    continue
                n = 1 if kind == "<" else len(text.split())
                if n:
                    for f in ["t:" + text] if kind == "<" else ["b:" + e.block, *e.names]:
                        sums.setdefault(f, [0, 0])[0 if e.article and e.apart < TAGGED else 1] += n
    rows = list(sums.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.string()), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.int64())],
        names=["feature", "inside", "outside"],
    )


def learn(pages: DataFrame, train_pages: int = 2000, features: int = 1 << 16, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights from at most ``train_pages`` distinct labelled pages.

    A tag's weight is in [-3, -0.01], a block's in [0.3, 1]; a name's is its log odds, kept where it has stood around enough
    words and on one side for the most part.
    """
    import math

    some = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).cast("string").alias("html"), F.xxhash64(id_col, html_col).alias("o"))
    # the hash below which train_pages pages lie, from hashes alone; then one filtered scan, of which equal rows count once
    cut = some.select("o").distinct().orderBy("o").limit(train_pages).agg(F.max("o")).first()[0]
    some = some.where(F.col("o") <= F.lit(cut).cast("long")).groupBy("o").agg(F.first("html").alias("html")).select("html")
    got = some.mapInArrow(_features, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    got = got.orderBy((F.col("i") + F.col("o")).desc(), "feature").limit(features).collect()
    weights = {}
    for r in got:
        odds = math.log((r["i"] + 0.5) / (r["o"] + 0.5))
        if r["feature"][0] == "t":
            weights[r["feature"]] = max(-3.0, min(odds / 2, -0.01))
        elif r["feature"][0] == "b":
            weights[r["feature"]] = max(0.3, min(1.0, (r["i"] + 10) / (r["i"] + r["o"] + 10)))  # unseen blocks are 1
        elif abs(odds) > 1 and r["i"] + r["o"] >= 20:
            weights[r["feature"]] = odds
    return weights


def _blocks(page: str, weights: dict[str, float]) -> list[list]:
    """[score of the tags before it, words, link words, block tag, set apart, in an article, text] of each block with text."""
    out: list[list] = []
    cost, pieces, links, current = 0.0, [], 0, None

    def close():
        nonlocal cost, pieces, links, current
        line = " ".join(entities.unescape("".join(pieces)).split())
        if line:
            out.append([cost, len(line.split()), links, current.block, current.apart if not current.rest else max(current.apart, current.rest), current.article, line])
            cost = 0.0
        pieces, links, current = [], 0, None

    for kind, text, e in tokens(page, weights):
        if kind == "<":
            tag = text.strip("/")
            if tag == "br":
                pieces.append(" ")
            elif tag not in INLINE:
                close()
            cost += weights.get("t:" + text, -0.05)
        else:
            if current is not None and (max(e.apart, e.rest) > 0) != (max(current.apart, current.rest) > 0):
                close()
            if current is None or not "".join(pieces).strip():
                current = e
            pieces.append(text)
            links += len(text.split()) if e.link else 0
    close()
    return out


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best run of blocks, a line a block."""
    blocks = _blocks(page or "", weights)
    # what sets apart: all, all but forms, or tags but forms, so that something is left
    in_forms = sum(b[1] for b in blocks if b[4] == FORM)
    for least in (2 if 2 * in_forms > sum(b[1] for b in blocks if b[4] < TAGGED) else 1, 3):
        free = [b[1] if b[4] < least else 0 for b in blocks]
        if any(free):
            break
    inside = sum(n for n, b in zip(free, blocks) if b[5])
    marked = 2 * inside >= sum(n for n, b in zip(free, blocks) if b[2] < 0.7 * b[1]) and inside > 0
    best, total, begin, run = 0.0, 0.0, 0, None
    for i, (cost, n, links, block, _, article, line) in enumerate(blocks):
        if not free[i] or (marked and not article):
            free[i] = 0
            score = APART - 0.1 * min(n, 50)
        elif links >= 0.7 * n:
            score = LINKS - 0.1 * min(n, 50)
        elif not article and n <= 25 and block not in PROSE and EDGES.search(line):
            score = EDGE
        else:
            words = weights.get("b:" + block, 1.0) * n
            score = max(words + cost, LEAST * words)
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, run = total, (begin, i)
    if run is None:  # nothing but links or edges: what isn't set apart
        run = (0, len(blocks) - 1)
    return "\n".join(b[6] for i, b in enumerate(blocks) if run[0] <= i <= run[1] and free[i])


def extract(pages: DataFrame, train_pages: int = 2000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    weights = learn(pages, train_pages, id_col=id_col, html_col=html_col)

    def run(batches):
        for b in batches:
            texts = [main_text(p, weights) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the main text of every page."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
