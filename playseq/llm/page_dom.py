"""A page as flat arrays: elements in page order with their parents, and runs of text between tags.

Pages come as they are found: end tags are missing or cross each other, text is cut anywhere. An
element that can't hold the next one is closed by it, an end tag without its start tag is skipped,
and formatting that crosses a block ends without closing it. Nothing here recurses, so nesting may
be of any depth.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Elements without content, elements whose content isn't markup, elements that
# start and end a block, formatting, and what the start of an element closes.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup "
    "option p pre search section summary table tbody td template tfoot th thead title tr ul".split()
)
FORMATTING = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup tt u var".split())
CLOSES_PARAGRAPH = BLOCK - {"body", "caption", "head", "html", "legend", "noscript", "optgroup", "option", "tbody", "td", "template", "tfoot", "th", "thead", "title", "tr"}
CLOSED_BY = {
    "li": {"li"},
    "dd": {"dd", "dt"},
    "dt": {"dd", "dt"},
    "option": {"option"},
    "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th", "caption"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tbody": {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"},
    "thead": {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"},
    "tfoot": {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"},
}
#: An element looks no further up than here for one that it closes.
FENCE = {
    "li": {"dir", "menu", "ol", "ul"},
    "dd": {"dl"},
    "dt": {"dl"},
    "option": {"datalist", "select"},
    "optgroup": {"select"},
}
TABLE_FENCE = frozenset({"table"})
#: An end tag inside a cell reaches out of it only if it ends a part of the table.
CELLS = frozenset({"td", "th", "table"})
TABLE_PARTS = frozenset("body html table tbody td tfoot th thead tr".split())

_MARK = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")


@dataclass
class Page:
    """Elements by number; the first stands for the page. Runs of text name their element and block."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    texts: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)

    def attribute(self, node: int) -> dict[str, str]:
        found = {}
        for name, *values in _ATTRIBUTE.findall(self.attributes[node]):
            found.setdefault(name.lower(), unescape("".join(values)))
        return found


class _Open:
    """The elements that are open, outermost first, and how many there are of each name."""

    def __init__(self, page: Page):
        self.page, self.nodes, self.counts = page, [0], Counter()

    def push(self, node: int) -> None:
        self.nodes.append(node)
        self.counts[self.page.tags[node]] += 1

    def cut(self, place: int, past: int | None = None) -> None:
        for node in self.nodes[place:past]:
            self.counts[self.page.tags[node]] -= 1
        del self.nodes[place:past]

    def inwards(self):
        """Places and names from the innermost one outwards, without the page itself."""
        for place in range(len(self.nodes) - 1, 0, -1):
            yield place, self.page.tags[self.nodes[place]]

    def end(self, tag: str) -> None:
        """Ends the innermost element of this name, with all inside it."""
        if not self.counts[tag]:
            return
        crossed = False
        for place, name in self.inwards():
            if name == tag:
                # Formatting that crosses a block ends without it.
                self.cut(place, place + 1 if crossed and tag in FORMATTING else None)
                return
            if name in CELLS and tag not in TABLE_PARTS or tag == "p" and name in BLOCK:
                return
            crossed = crossed or name in BLOCK

    def make_room(self, tag: str) -> None:
        """Ends the elements that can't hold one of this name."""
        closed = CLOSED_BY.get(tag, frozenset())
        while any(self.counts[c] for c in closed):
            for place, name in self.inwards():
                if name in FENCE.get(tag, TABLE_FENCE):
                    closed = frozenset()
                    break
                if name in closed:
                    self.cut(place)
                    break
        if tag in CLOSES_PARAGRAPH and self.counts["p"]:
            for place, name in self.inwards():
                if name == "p":
                    self.cut(place)
                if name in BLOCK:
                    break


def parse(html: str) -> Page:
    """Elements and text of a page, with character references decoded.

    As in browsers, a script, style or title that never ends takes all the rest of the page.
    """
    page = Page()
    held = _Open(page)
    block = at = 0

    def say(text: str) -> None:
        if text:
            page.texts.append(unescape(text) if "&" in text else text)
            page.owners.append(held.nodes[-1])
            page.blocks.append(block)

    for mark in iter(lambda: _MARK.search(html, at), None):
        say(html[at : mark.start()])
        at = mark.end()
        if mark["tag"] is None:
            continue
        tag = mark["tag"].lower()
        block += tag in BLOCK
        if mark["close"]:
            held.end(tag)
            continue
        held.make_room(tag)
        page.tags.append(tag)
        page.parents.append(held.nodes[-1])
        page.attributes.append(mark["rest"])
        if tag == "br":
            say(" ")
        if tag in VOID:
            continue
        held.push(len(page.tags) - 1)
        if tag in RAW:
            stop = _RAW_ENDS[tag].search(html, at)
            past = stop.start() if stop else len(html)
            say(html[at:past])
            at = past
    say(html[at:])
    return page
