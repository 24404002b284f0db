"""A small element tree over the standard HTML parser, for Arrow-batched page functions.

Selectors are the few forms the page rules use: tag, .class, #id, [attr='v'], compounds of them,
and a descendant blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from colloquy import vocab

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """Descendants in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def text(self) -> str:
        parts: list[str] = []
        stack: list[Element | str] = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(parts)

    def ancestors(self) -> Iterator[Element]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def first(self, *selectors: str) -> Element | None:
        return next((e for e in self.walk() if any(matches(e, s) for s in selectors)), None)

    def every(self, *selectors: str) -> list[Element]:
        return [e for e in self.walk() if any(matches(e, s) for s in selectors)]

    def closest(self, selector: str) -> Element | None:
        return next((e for e in (self, *self.ancestors()) if matches(e, selector)), None)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


_SIMPLE = re.compile(r"([.#]?)([\w-]+)|\[([\w-]+)=['\"]([^'\"]*)['\"]\]")


def _matches_compound(element: Element, compound: str) -> bool:
    for kind, name, attr, value in _SIMPLE.findall(compound):
        if attr:
            ok = element.attrs.get(attr) == value
        elif kind == ".":
            ok = name in element.attrs.get("class", "").split()
        elif kind == "#":
            ok = element.attrs.get("id") == name
        else:
            ok = element.tag == name
        if not ok:
            return False
    return True


def matches(element: Element, selector: str) -> bool:
    *outer, last = selector.split()
    if not _matches_compound(element, last):
        return False
    chain = element.ancestors()
    return all(any(_matches_compound(a, compound) for a in chain) for compound in reversed(outer))


class _TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#document", {}, None)
        self.top = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.top.tag in _CLOSES.get(tag, ()):
            self.top = self.top.parent or self.root
        node = Element(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(node)
        if tag not in _VOID:
            self.top = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.top.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.top))

    def handle_endtag(self, tag: str) -> None:
        node: Element | None = self.top
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.top = node.parent

    def handle_data(self, data: str) -> None:
        self.top.children.append(data)


def parse(html: str) -> Element:
    builder = _TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def _numeric(digits: str, base: int) -> str:
    code = int(digits, base)
    return chr(code) if 0 < code <= 0x10FFFF else ""


def decode_entities(text: str) -> str:
    text = re.sub(r"&([a-zA-Z]+);", lambda m: vocab.HTML_ENTITIES.get(m[1], m[0]), text)
    text = re.sub(r"&#(\d+);", lambda m: _numeric(m[1], 10), text)
    return re.sub(r"&#[xX]([0-9a-fA-F]+);", lambda m: _numeric(m[1], 16), text)


def clean_text(element: Element | None) -> str:
    return re.sub(r"\s+", " ", decode_entities(element.text())).strip() if element is not None else ""


def page_title(root: Element) -> str:
    title = root.first("title")
    if title is not None and title.text():
        return decode_entities(title.text().strip())
    meta = next((m for m in root.every("meta") if m.attrs.get("property") == "og:title" and m.attrs.get("content")), None)
    if meta is not None:
        return decode_entities(meta.attrs["content"].strip())
    heading = root.first("h1")
    return decode_entities(heading.text().strip()) if heading is not None else ""


def _drop(root: Element, selectors: list[str]) -> None:
    for element in root.every(*selectors):
        element.remove()


def _content_score(element: Element, length: int) -> float:
    """Long text with paragraphs and few links wins."""
    links = len(element.every("a"))
    return 0.5 * length + 50 * len(element.every("p")) + 0.1 * (length / links if links else length)


def main_element(root: Element) -> Element:
    for selector in vocab.CONTENT_SELECTORS:
        found = root.first(selector)
        if found is not None and len(found.text().strip()) > 100:
            return found
    best, best_score = None, 0.0
    for element in root.every("div", "section"):
        length = len(element.text().strip())
        if length > 200:
            score = _content_score(element, length)
            if best is None or score > best_score:
                best, best_score = element, score
    return best if best is not None else (root.first("body") or root)


def main_text(root: Element, domain: str = "") -> str:
    """Text of the main content; domains with their own rules use those first."""
    rules = next((r for name, r in vocab.DOMAIN_CONTENT_SELECTORS.items() if name in domain), None)
    if rules is not None and rules[1]:
        _drop(root, rules[1])
    _drop(root, vocab.NON_CONTENT_SELECTORS)
    if rules is not None:
        found = root.first(*rules[0])
        if found is not None:
            return clean_text(found)
    return clean_text(main_element(root))
