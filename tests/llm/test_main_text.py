"""Main texts of pages: the given ones by a plain reading, others by hand."""

import math
import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from playseq.llm.main_text import density, extract, main_text
from playseq.llm.page_dom import BLOCK, parse


class Article(HTMLParser):
    """The text between <article> and its end, a line for each stretch without a block's tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in BLOCK:
            self.lines.append("")
        elif tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in BLOCK:
            self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data

    @classmethod
    def of(cls, html):
        reader = cls()
        reader.feed(html or "")
        reader.close()
        return "\n".join(line for line in (" ".join(x.split()) for x in reader.lines) if line)


def test_given_pages(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    rows = extract(spark.read.parquet(path)).collect()
    want = {r["page_id"]: (r["url"], Article.of(r["html"])) for r in pq.read_table(path).to_pylist()}
    assert len(rows) == len(want)
    for r in rows:
        assert (r.row.url, r.text) == want[r.row.page_id]
        assert r.n_chars == len(r.text)


SENTENCE = "The committee met on Tuesday to discuss the budget, and most members spoke for it. "
MENU = "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(12))


@pytest.mark.parametrize("article,end", [("<div class=story>", "</div>"), ("<td>", "</td>"), ('<div id="main-content">', "</div>"), ("<main>", "</main>")])
def test_articles_without_article_tag(article, end):
    table = article == "<td>"
    page = (
        f"<html><body><div class=nav><ul>{MENU}</ul></div>{'<table><tr>' if table else ''}{article}<h1>Budget</h1>"
        f"<p>{SENTENCE * 4}</p><p>{SENTENCE * 3}</p><p>Short.</p>{end}{'</tr></table>' if table else ''}"
        f"<div class=sidebar><p>{SENTENCE}</p></div><div id=comments><p>{SENTENCE * 2}</p></div>"
        "<div class='cookie-notice'>We use cookies.</div><p>&copy; 2020 Someone</p></body></html>"
    )
    assert main_text(page) == "\n".join(["Budget", (SENTENCE * 4).strip(), (SENTENCE * 3).strip(), "Short."])


def test_lists_quotes_and_code_inside_an_article_stay():
    page = f"<body><nav>{MENU}</nav><article><h1>T</h1><p>{SENTENCE}</p><ul><li>one<li>two &amp; <a href=x>three</a></ul><pre>a\n  b</pre><blockquote>q</blockquote><aside>{SENTENCE}</aside></article></body>"
    assert main_text(page) == "\n".join(["T", SENTENCE.strip(), "one", "two & three", "a b", "q"])


def test_references_white_space_and_broken_markup():
    page = f"<article><p>a&nbsp;&eacute;&#233;&#x4e2d;\t b<br>c<b>d<p>e <i>f</p></i> g<!-- h --> &unknown; {SENTENCE}<script>x</script><p title='>'>i</article"
    assert main_text(page) == f"a éé中 b cd\ne f\ng &unknown; {SENTENCE.strip()}\ni"


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", f"<nav>{MENU}</nav>", "<script>x = '<p>y</p>'</script>", "<!--", "<style>p"])
def test_pages_without_text(html):
    assert main_text(html) == ""


def test_plain_text_is_its_own_article():
    assert main_text("just  words") == "just words"
    assert main_text("<") == "<"


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    long = "".join(f"<p>{SENTENCE}{k}</p>" for k in range(20_000))
    assert main_text(f"<body><article>{long}</article></body>").count("\n") == 19_999


def test_rows_stay_rows(spark):
    columns = "page_id bigint, url string, html string, text int, n_chars string, row string"
    rows = [(1, "u", "<p>a</p>", 1, "n", "r"), (1, "u", "<p>a</p>", 1, "n", "r"), (None, None, None, None, None, None), (2, None, "", 1, "n", "r")]
    found = extract(spark.createDataFrame(rows, columns)).collect()
    assert sorted((r.row.page_id or 0, r.row.url or "", r.text, r.n_chars) for r in found) == [(0, "", "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (2, "", "", 0)]
    assert extract(spark.createDataFrame([], columns)).collect() == []


def test_density_sums_by_recursion():
    """Densities of random trees, added up child by child, choose the same subtree."""
    rng = random.Random(3)

    def tree(depth):
        if not depth or rng.random() < 0.3:
            return ("a" if rng.random() < 0.2 else "span", "x" * rng.randint(1, 60), [])
        return ("div", "", [tree(depth - 1) for _ in range(rng.randint(1, 4))])

    def markup(node):
        tag, text, inner = node
        return f"<{tag}>{text}{''.join(map(markup, inner))}</{tag}>"

    def counts(node):
        tag, text, inner = node
        below = [counts(x) for x in inner]
        chars, tags = len(text) + sum(b[0] for b in below), sum(b[1] + 1 for b in below)
        if tag == "a":
            return chars, tags, chars, tags
        return chars, tags, sum(b[2] for b in below), sum(b[3] + (x[0] == "a") for b, x in zip(below, inner, strict=True))

    for _ in range(50):
        root = tree(4)
        chars, tags, link_chars, link_tags = counts(root)
        page = parse(markup(root))
        assert len(page.tags) == tags + 2
        assert sum(map(len, page.texts)) == chars
        plain = max(chars - max(link_chars, 1), 1)
        base = max(link_chars, 1) / chars
        by_hand = chars / max(tags, 1) * max(math.log(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)), 0) / math.log(math.log(chars / plain * max(link_chars, 1) + base * chars + math.e))
        assert density(chars, tags, link_chars, link_tags, base) == pytest.approx(by_hand)
