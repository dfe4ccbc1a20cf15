"""A page as a tree, for worker processes: nodes in document order, each with the place where its subtree ends.

A subtree is a range of places, so finding and reading are loops, and no depth of nesting can exhaust the stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from .html import VOID

QUIET = frozenset(("script", "style"))
# Plain markup, which needs no parser: lower-case tags with quoted attributes, no references, no elements with rules of their own.
PLAIN = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"<>&]*")*)>|</([a-z][a-z0-9]*)>|([^<&]+)')
ATTRIBUTE = re.compile(r' ([a-z][a-z-]*)="([^"]*)"')
RAW = frozenset(("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "svg", "math"))
STEP = re.compile(r"([a-z][a-z0-9]*)?(?:#([\w-]+))?(?:\.([\w-]+))?(?:\[([\w:-]+)(?:=([^\]]*))?\])?")


class _Builder(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self._clear()
        if not self._plain(html):
            self._clear()
            self.feed(html)
            self.close()
        self._shut(0)

    def _clear(self) -> None:
        # A node's name is '' for text, which then stands in place of attributes.
        self.names: list[str] = ["#page"]
        self.held: list = [{}]
        self.ends: list[int] = [0]
        self.open = [0]

    def _plain(self, html: str) -> bool:
        """Reads plain markup as the parser would; false where html is not."""
        if "&" in html:
            return False
        at = 0
        for m in iter(PLAIN.scanner(html).match, None):
            tag, attributes, closed, data = m.groups()
            at = m.end()
            if data is not None:
                self._add("", data)
            elif closed is not None:
                self.handle_endtag(closed)
            elif tag in RAW:
                return False
            else:
                self.handle_starttag(tag, ATTRIBUTE.findall(attributes) if attributes else ())
        return at == len(html)

    def _shut(self, keep: int) -> None:
        for at in self.open[keep:]:
            self.ends[at] = len(self.names)
        del self.open[keep:]

    def _add(self, name: str, held) -> None:
        self.names.append(name)
        self.held.append(held)
        self.ends.append(len(self.names))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._add(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(len(self.names) - 1)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.names[self.open[depth]] == tag:
                self._shut(depth)
                break

    def handle_data(self, data: str) -> None:
        self._add("", data)


_STEPS: dict[str, tuple[str | None, ...]] = {}


def _step(step: str) -> tuple[str | None, ...]:
    fit = STEP.fullmatch(step)
    if not fit:
        raise ValueError(f"not a step of a path: {step}")
    return fit.groups()


class Element:
    """A node, or the want of one, which is false, has no text and holds nothing. Paths are steps between spaces, each
    tag#id.class[attribute=value] or a part of it; every step but the last takes the first node that fits."""

    __slots__ = ("_at", "_page")

    def __init__(self, page: _Builder, at: int) -> None:
        self._page, self._at = page, at

    def __bool__(self) -> bool:
        return self._at >= 0

    @property
    def tag(self) -> str:
        return self._page.names[self._at] if self else ""

    def get(self, name: str, other: str = "") -> str:
        return self._page.held[self._at].get(name, other) if self else other

    def has(self, name: str) -> bool:
        return bool(self) and name in self._page.held[self._at]

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    def _inside(self) -> range:
        return range(self._at + 1, self._page.ends[self._at]) if self else range(0)

    def every(self, path: str) -> Iterator[Element]:
        *outer, last = path.split()
        root = self
        for step in outer:
            root = root.one(step)
        tag, own_id, cls, name, value = _STEPS.get(last) or _STEPS.setdefault(last, _step(last))
        for at in root._inside():
            found, held = self._page.names[at], self._page.held[at]
            if not found or (tag and found != tag) or (own_id and held.get("id") != own_id):
                continue
            if cls and cls not in held.get("class", "").split():
                continue
            if name and (name not in held or (value is not None and held[name] != value)):
                continue
            yield Element(self._page, at)

    def one(self, path: str) -> Element:
        return next(self.every(path), Element(self._page, -1))

    def children(self) -> Iterator[Element]:
        at = self._at + 1
        while self and at < self._page.ends[self._at]:
            if self._page.names[at]:
                yield Element(self._page, at)
            at = self._page.ends[at]

    def text(self) -> str:
        """All text but that of scripts and styles, white space collapsed."""
        parts, after = [], 0
        for at in ([self._at] if self else []) + list(self._inside()):
            if at < after:
                continue
            if self._page.names[at] in QUIET:
                after = self._page.ends[at]
            elif not self._page.names[at]:
                parts.append(self._page.held[at])
        return " ".join(" ".join(parts).split())

    def source(self) -> str:
        """The text as it stands, as of a script."""
        return "".join(self._page.held[at] for at in self._inside() if not self._page.names[at])


def tree(html: str | None) -> Element:
    return Element(_Builder(html or ""), 0)
