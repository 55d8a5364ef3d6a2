"""Per-page helper of the HTML extraction (runs inside Arrow-batched tasks).

The page is read once by the standard library's tokenizer into flat tables in document
order: text pieces, and elements with their parent and the range of pieces they cover.
Comments, scripts and styles give no text; a paragraph ends where the next one, another
block or its parent's end begins, taking unclosed inline elements with it. Nothing
recurses, so pages of any depth and length are read whole. Selectors are `tag`, `.class`,
`tag.class` and descendant chains of them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Fixed values of HTML: elements without content, and elements whose start ends an open
# paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
# A start tag of the key ends an open element of its values (inside the same list or table).
ENDS = {"li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
        "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table select article section div body html".split())
SILENT = frozenset(("script", "style"))
_WS = re.compile(r"[\s\x1c-\x1f]+")


def clean(s: str) -> str:
    return _WS.sub(" ", s).strip()


class Page(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.classes: list[frozenset[str]] = []
        self.parents: list[int] = []
        self.first: list[int] = []  # first text piece inside, and one past the last
        self.past: list[int] = []
        self.pieces: list[str] = []
        self.open: list[int] = []
        self.feed(html)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        for k in self.open[depth:]:
            self.past[k] = len(self.pieces)
        del self.open[depth:]

    def _end_last(self, tags, scopes) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.tags[self.open[depth]]
            if tag in tags:
                self._end(depth)
                return
            if tag in scopes:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_last(("p",), SCOPES)
        if tag in ENDS:
            self._end_last(ENDS[tag], SCOPES)
        self.tags.append(tag)
        self.classes.append(frozenset((dict(attrs).get("class") or "").split()))
        self.parents.append(self.open[-1] if self.open else -1)
        self.first.append(len(self.pieces))
        self.past.append(len(self.pieces))
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close other elements in HTML

    def handle_endtag(self, tag: str) -> None:
        self._end_last((tag,), ())

    def handle_data(self, data: str) -> None:
        if not (self.open and self.tags[self.open[-1]] in SILENT):
            self.pieces.append(data)

    def text(self, k: int) -> str:
        parts = (s.strip() for s in self.pieces[self.first[k] : self.past[k]])
        return clean(" ".join(s for s in parts if s))

    def _fits(self, k: int, step: str) -> bool:
        tag, _, name = step.partition(".")
        return (not tag or self.tags[k] == tag) and (not name or name in self.classes[k])

    def select(self, selector: str, inside: int = -1) -> list[int]:
        """Elements that match, in document order; all of them below `inside`."""
        steps, found = selector.split(), []
        for k in range(inside + 1, len(self.tags)):
            if not self._fits(k, steps[-1]):
                continue
            left, above, below = len(steps) - 2, self.parents[k], inside < 0
            while above >= 0 and (left >= 0 or not below):
                if left >= 0 and self._fits(above, steps[left]):
                    left -= 1
                below = below or above == inside
                above = self.parents[above]
            if left < 0 and below:
                found.append(k)
        return found

    def first_hits(self, selectors, inside: int = -1) -> list[int]:
        """Matches of the first selector that has any; a container may itself match."""
        for selector in selectors:
            if inside >= 0 and len(selector.split()) == 1 and self._fits(inside, selector):
                return [inside]
            if found := self.select(selector, inside):
                return found
        return []


def extract_pairs(html: str, text_selectors, date_selectors, container: str | None = None) -> list[tuple[str, str]]:
    """(text, date) per comment. Without a container: first selector with any hit,
    paired by position (the reference behaviour). With one: pairs are taken inside
    each container element, so a comment without a date cannot shift the others."""
    page = Page(html)
    if container is None:
        dates = page.first_hits(date_selectors)
        texts = page.first_hits(text_selectors)
        return [(page.text(t), page.text(dates[i]) if i < len(dates) else "") for i, t in enumerate(texts)]
    pairs = []
    for box in page.select(container):
        text, date = page.first_hits(text_selectors, box), page.first_hits(date_selectors, box)
        pairs.append((page.text(text[0]) if text else "", page.text(date[0]) if date else ""))
    return pairs
