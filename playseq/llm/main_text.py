"""The main text of web pages by composite text density.

Every element has a density: its characters for each tag, weighed by how little of it is links. The
elements' densities add up to their parent's density sum, and the element with the largest sum holds
the article. The smallest density on the way from there to the body is the page's threshold: what
stands beside that way and reaches it belongs to the article too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.llm.page_dom import Page, parse
from playseq.llm.text import slices

# Elements that are never part of an article; roles that say the same; words in a
# class or id that do; words in them that mark an article whatever else they say.
DROPPED_TAGS = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form frame frameset head iframe input map menu meter "
    "nav noembed noframes noscript object optgroup option progress script search select style svg template textarea title video xmp".split()
)
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split()
)
DROPPED_WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs "
    "comment commentlist comments consent cookie cookies copyright crumbs disqus dropdown flyout foot footer footnav "
    "gdpr hidden login masthead menu menus menubar modal nav navbar navigation navigator newsletter notice notices notification "
    "notifications overlay paginate pagination pager popup privacy promo promoted promotion recommendation recommendations "
    "recommended related replies reply respond search share sharebar sharing sidebar sidenav signin signup skip skiplink "
    "skyscraper social sponsor sponsored sponsors subscribe subscription syndication tagcloud taboola toolbar topbar "
    "topnav trackback tracking trending widget widgets".split()
)
#: Names that begin so speak of something else ("with-sidebar").
ABOUT_OTHERS = frozenset({"has", "is", "no", "not", "with", "without"})
HEADER_WORDS = frozenset({"header", "pageheader", "siteheader", "topheader"})
ARTICLE_TAGS = frozenset({"article", "main"})
HEADINGS = frozenset({"h1", "h2", "h3"})
# How a copyright line begins.
NOTICES = ("©", "(c)", "copyright", "all rights reserved")
#: A larger share of link characters marks a list of links.
LINK_SHARE = 0.5

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def is_dropped(page: Page, node: int, in_article: bool, by_name: bool) -> bool:
    """Whether an element is a menu, notice, advert, form or other matter around an article.

    `by_name` also goes by the words in its class and id.
    """
    tag = page.tags[node]
    if tag in DROPPED_TAGS or (tag == "header" and not in_article):
        return True
    if not page.attributes[node] or tag in ("html", "body"):
        return False
    said = page.attribute(node)
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or said.get("role", "").lower() in DROPPED_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said.get("style", ""), re.IGNORECASE):
        return True
    if not by_name or tag == "main" or said.get("role", "").lower() == "main" or said.get("itemprop") == "articleBody":
        return False
    # The last word of a name says what it is ("post-comments", "cookie_notice"), the first whose it is.
    names = [[w.lower() for w in _WORDS.findall(name)] for name in (said.get("class", "") + " " + said.get("id", "")).split()]
    if tag == "article":
        return any(words and words[0] in ("comment", "comments", "reply", "related", "ad", "advert", "promo", "sponsored", "teaser") for words in names)
    for words in names:
        if not words or words[0] in ABOUT_OTHERS:
            continue
        if words[-1] in DROPPED_WORDS or words[0] in DROPPED_WORDS or "".join(words) in DROPPED_WORDS:
            return True
        if not in_article and (words[-1] in HEADER_WORDS or "".join(words) in HEADER_WORDS):
            return True
    return False


def density(chars: int, tags: int, link_chars: int, link_tags: int, base: float) -> float:
    """Link-adjusted characters for each tag; counts of nothing are taken as one."""
    tags, link_chars, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    if not chars:
        return 0.0
    plain = max(chars - link_chars, 1)
    logarithm = math.log(chars / plain * link_chars + base * chars + math.e)
    return chars / tags * max(math.log(chars / link_chars * tags / link_tags), 0.0) / math.log(logarithm)


def main_text(html: str | None) -> str:
    """The article of one page: its blocks' texts, a line each; empty if there is none."""
    if not html:
        return ""
    page = parse(html)
    # Where the names of classes leave nothing, they meant something else.
    return _article(page, by_name=True) or _article(page, by_name=False)


def _article(page: Page, by_name: bool) -> str:
    n = len(page.tags)
    has_main = [tag == "main" for tag in page.tags]
    for node in range(n - 1, 0, -1):
        has_main[page.parents[node]] |= has_main[node]
    dropped, in_article, in_link = [False] * n, [False] * n, [False] * n
    for node in range(1, n):
        parent = page.parents[node]
        dropped[node] = dropped[parent] or is_dropped(page, node, in_article[parent], by_name and not has_main[node])
        in_article[node] = in_article[parent] or page.tags[node] in ARTICLE_TAGS
        in_link[node] = in_link[parent] or page.tags[node] == "a"

    # Children have larger numbers than their parents, so one pass backwards adds up every subtree.
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    own, first = [0] * n, [len(page.texts)] * n
    for k, (text, node) in enumerate(zip(page.texts, page.owners, strict=True)):
        if not dropped[node] and not text.isspace():
            first[node] = min(first[node], k)
            size = len("".join(text.split()))
            own[node] += size
            chars[node] += size
            if in_link[node]:
                link_chars[node] += size
    for node in range(n - 1, 0, -1):
        if not dropped[node]:
            parent = page.parents[node]
            chars[parent] += chars[node]
            link_chars[parent] += link_chars[node]
            tags[parent] += tags[node] + 1
            first[parent] = min(first[parent], first[node])
            link_tags[parent] += link_tags[node] + in_link[node]
    if not chars[0]:
        return ""
    base = max(link_chars[0], 1) / chars[0]
    densities = [0.0 if dropped[k] else density(chars[k], tags[k], link_chars[k], link_tags[k], base) for k in range(n)]
    # Text straight inside an element counts like a child without tags.
    sums = [density(own[k], 1, own[k] if in_link[k] else 0, in_link[k], base) if own[k] else 0.0 for k in range(n)]
    for node in range(1, n):
        sums[page.parents[node]] += densities[node]

    best = max(range(n), key=lambda k: (sums[k], k))
    way = [best]
    while way[-1]:
        way.append(page.parents[way[-1]])
    inner = dict(zip(way[1:], way[:-1], strict=True))
    threshold = min(densities[k] for k in way)
    chosen = [False] * n
    chosen[best] = True
    for node in way:
        # Inside an article everything that is left belongs to it.
        if page.tags[node] in ARTICLE_TAGS or page.attributes[node] and page.attribute(node).get("role", "").lower() == "main":
            chosen[node] = True
    for node in range(1, n):
        parent = page.parents[node]
        if chosen[parent]:
            chosen[node] = True
        elif inner.get(parent, node) != node and chars[node] and link_chars[node] <= LINK_SHARE * chars[node]:
            heading = page.tags[node] in HEADINGS and node < inner[parent]
            notice = page.texts[first[node]].strip().lower().startswith(NOTICES)
            chosen[node] = heading or densities[node] >= threshold and not notice
    return _joined(page, chosen, dropped)


def _joined(page: Page, chosen: Sequence[bool], dropped: Sequence[bool]) -> str:
    lines: list[str] = []
    parts: list[str] = []
    current = -1
    for text, node, block in zip(page.texts, page.owners, page.blocks, strict=True):
        if dropped[node] or not chosen[node]:
            continue
        if block != current:
            lines.append("".join(parts))
            parts, current = [], block
        parts.append(text)
    lines.append("".join(parts))
    return "\n".join(line for line in (" ".join(x.split()) for x in lines) if line)


def extract(pages: DataFrame, *, html: str = "html", carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The main text of every page, from the whole page.

    Returns, one row for each page: `row` (a struct of the `carry` columns, whatever their names),
    text (empty if there is none: a null or empty page, or one of menus only) and n_chars (its code
    points). Repeated rows get equal results. Pages are independent of each other, so nothing is
    shuffled; a task holds one slice of pages, or one very long page, at a time.
    """
    chosen = pages.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(f"`{html}`").alias("html"))

    def read(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), lengths], ["row", "text", "n_chars"])

    return chosen.mapInArrow(read, f"row {chosen.schema['row'].dataType.simpleString()}, text string, n_chars long")
