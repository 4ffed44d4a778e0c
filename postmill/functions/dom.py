"""A flat outline of one HTML page, for use inside Arrow batch jobs only.

Text pieces are kept in document order and each element records the span of
pieces it covers, so the text of any element is a slice."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

# --- Fixed values: elements without content, elements whose text is not shown
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem",
    "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image",
    "isindex", "nextid", "spacer",
)
HIDDEN_TAGS = ("script", "style", "template", "rt", "rp")


class Element:
    __slots__ = ("tag", "attrs", "first", "last", "parent")

    def __init__(self, tag, attrs, first, parent):
        self.tag, self.attrs, self.first, self.parent = tag, attrs, first, parent
        self.last = None  # still open


class Outline(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.pieces: list[tuple[str, bool]] = []
        self.elements: list[Element] = []
        self._stack: list[Element] = []
        self._open: Counter[str] = Counter()  # open elements by tag, so that no step scans them
        self._hidden = 0
        self._pending: list[str] = []
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self):
        if self._pending:
            self.pieces.append(("".join(self._pending), self._hidden > 0))
            self._pending = []

    def _enter(self, tag, attrs):
        self._flush()
        parent = self._stack[-1] if self._stack else None
        element = Element(
            tag, {k: v or "" for k, v in attrs}, len(self.pieces), parent
        )
        self.elements.append(element)
        self._stack.append(element)
        self._open[tag] += 1
        self._hidden += tag in HIDDEN_TAGS

    def _leave(self, tag):
        self._flush()
        closed = None
        while self._open[tag] and (closed is None or closed.tag != tag):
            closed = self._stack.pop()  # an end tag closes everything left open inside it
            closed.last = len(self.pieces)
            self._open[closed.tag] -= 1
            self._hidden -= closed.tag in HIDDEN_TAGS
            if closed.tag == tag:
                break

    def handle_starttag(self, tag, attrs):
        self._enter(tag, attrs)
        if tag in VOID_TAGS:
            self._leave(tag)

    def handle_startendtag(self, tag, attrs):
        self._enter(tag, attrs)
        self._leave(tag)

    def handle_endtag(self, tag):
        self._leave(tag)

    def handle_data(self, data):
        self._pending.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._flush()
        if data[:6].upper() == "CDATA[":
            self.pieces.append((data[6:], False))

    # --- reading ---------------------------------------------------------------

    def text(self, element: Element | None = None, sep: str = " ") -> str:
        """Shown text: pieces stripped, empty ones left out, joined."""
        first, last = (element.first, element.last) if element else (0, None)
        shown = (t.strip() for t, hidden in self.pieces[first:last] if not hidden)
        return sep.join(t for t in shown if t)

    def raw(self, element: Element) -> str:
        return "".join(t for t, _ in self.pieces[element.first:element.last])

    def first_tag(self, *tags: str) -> Element | None:
        return next((e for e in self.elements if e.tag in tags), None)

    def first_attr(self, name: str, pattern: re.Pattern) -> Element | None:
        return next(
            (e for e in self.elements if name in e.attrs and pattern.search(e.attrs[name])),
            None,
        )


def plain_text(value: str) -> str:
    """Text of an HTML fragment, or of plain text, with blanks squashed.

    What the parser cannot read is taken as plain text."""
    if "<" in value and ">" in value:
        try:
            value = Outline(value.strip()).text()
        except AssertionError:  # what it raises on a declaration that is none
            pass
    return " ".join(value.split())
