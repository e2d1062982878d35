"""HTML to a tree, by a small builder over the standard tokenizer; the tree as blocks and as rows."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

from docloom.functions.text import WS_CHARS

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
HEAD = set("base link meta noscript script style title".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul dd dt".split())
SCOPE = set("html table td th caption template object marquee applet button".split())
RCDATA = set("textarea title".split())
RAW = set("iframe noembed noframes plaintext xmp".split())
TABLE_CONTEXT = set("table tbody tfoot thead tr".split())
TABLE_PARTS = TABLE_CONTEXT | set("caption col colgroup form script style td template th".split())
FOREIGN = {"svg", "math"}
HTML_WITHIN = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
WHOLE = {"html", "head", "body"}
#: Parts of a table, and the elements in which they stand.
WITHIN_TABLE = dict.fromkeys(("tbody", "thead", "tfoot"), {"table"}) | {"tr": {"table", "tbody", "thead", "tfoot"}} | dict.fromkeys(("td", "th"), {"table", "tbody", "thead", "tfoot", "tr"})
HEADINGS = {f"h{k}" for k in range(1, 7)}
BLOCKS = CLOSES_P | {"tr", "td", "th", "tbody", "thead", "tfoot", "body"}
MAX_LEVELS = 512  # of elements in each other, as browsers have it
CONTAINERS = {"div", "section", "article", "main", "header", "footer"}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def put(self, node: Node, at: int | None = None) -> None:
        """As a child, the last one or at a place, wherever it was before."""
        if node.parent is not None:
            node.parent.children = [c for c in node.parent.children if c is not node]
        self.children.insert(len(self.children) if at is None else at, node)
        node.parent = self

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag != "template":
                stack.extend(reversed(n.children))
        return "".join(out)

    def find(self, tags: set[str]) -> list[Node]:
        """Descendants with one of the tags, in document order."""
        out, stack = [], list(reversed(self.children))
        while stack:
            n = stack.pop()
            if not isinstance(n, str):
                if n.tag in tags:
                    out.append(n)
                stack.extend(reversed(n.children))
        return out


_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


#: A text without comments, declarations, raw texts, drawings, and attributes that need more than a cut: its tags and texts.
_OTHERS = "(?!/?(?i:script|style|textarea|title|iframe|noembed|noframes|noscript|plaintext|xmp|svg|math)[ \\t\\n>])"
_NAME, _VALUES = "[A-Za-z][A-Za-z0-9]*+", r"""(?:[ \t\n]++[a-z]++="[^"&<>]*+")*+"""
_PLAIN = re.compile(f"(?:[^<]++|<{_OTHERS}(?:/{_NAME}|{_NAME}{_VALUES})>)*+")
_PLAIN_TOKEN = re.compile(f"<(/?)({_NAME})({_VALUES})>|([^<]++)")
_PLAIN_ATTRIBUTE = re.compile(r'([a-z]+)="([^"]*)"')


def attribute_text(raw: str) -> str:
    """Character references of an attribute; a name without semicolon stays if = or a letter or digit follows."""

    def decoded(m: re.Match) -> str:
        name = m[0][1:]
        if name[0] == "#" or name in html5 and (name[-1] == ";" or raw[m.end() : m.end() + 1] != "="):
            return unescape(m[0])
        return m[0]

    return _REFERENCE.sub(decoded, raw)


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body = Node("body")
        self.open = [self.body]
        self.active: list[Node | None] = []  # formatting elements; None marks a cell
        self.begun = self.in_head_text = self.frames = False
        self.drawn = self.scripted = False  # whether there were drawings or formulas, and scripts or styles

    def _in_scope(self, tag: str) -> bool:
        for n in reversed(self.open):
            if n.tag == tag:
                return True
            if n.tag in SCOPE:
                return False
        return False

    def _pop_to(self, tags: set[str]) -> None:
        while len(self.open) > 1 and self.open.pop().tag not in tags:
            pass

    def _pop_below(self, tags: set[str]) -> None:
        while len(self.open) > 1 and self.open[-1].tag not in tags:
            self.open.pop()

    def _reopen(self) -> None:
        """Formatting elements that were cut off by the end of a block go on in the next one."""
        if not self.active or self.active[-1] is None:
            return
        start = max((k + 1 for k, n in enumerate(self.active) if n is None), default=0)
        for k in range(start, len(self.active)):
            if self.active[k] not in self.open:
                self.active[k] = self._push(Node(self.active[k].tag, self.active[k].attrs))

    def _add(self, new: Node | str) -> None:
        """To the current element; what a table can't hold goes before the table. Text joins text before it."""
        into, text = self.open[-1], isinstance(new, str)
        if into.tag in TABLE_CONTEXT and (text or new.tag not in TABLE_PARTS) or not text and new.parent is not None:
            self._add_to(len(self.open) - 1, new)
        elif not text:
            into.children.append(new)
            new.parent = into
        elif into.children and isinstance(into.children[-1], str):
            into.children[-1] += new
        else:
            into.children.append(new)

    def _add_to(self, level: int, new: Node | str) -> None:
        into = self.open[level]
        at = len(into.children)
        if into.tag in TABLE_CONTEXT and (new.strip(WS_CHARS) if isinstance(new, str) else new.tag not in TABLE_PARTS):
            k = max((k for k, n in enumerate(self.open[: level + 1]) if n.tag == "table"), default=0)
            into = self.open[k - 1]
            at = next((j for j in range(len(into.children) - 1, -1, -1) if into.children[j] is self.open[k]), len(into.children))
        if not isinstance(new, str):
            into.put(new, at)
        elif at and isinstance(into.children[at - 1], str):
            into.children[at - 1] += new
        else:
            into.children.insert(at, new)

    def _push(self, node: Node) -> Node:
        if len(self.open) >= MAX_LEVELS:  # beside the element that is open, not in it
            self.open.pop()
        self._add(node)
        self.open.append(node)
        return node

    def _attributes(self, attrs: list) -> dict[str, str]:
        source = self.get_starttag_text() or ""
        if "&" in source:
            # the tokenizer decodes references as in text, so values are read again
            found = _ATTRIBUTE.findall(re.sub(r"^<[^\s/>]+", "", source))
            attrs = [(k.lower(), attribute_text(v[1:-1] if v[:1] in ("'", '"') and v[-1:] == v[:1] and len(v) > 1 else v)) for k, v in found]
        out: dict[str, str] = {}
        for k, v in attrs:
            out.setdefault(k, v or "")
        return out

    def _in_foreign(self) -> bool:
        """Whether the open element belongs to a drawing or formula; some of those hold HTML again."""
        if not self.drawn:
            return False
        k = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag in FOREIGN), None)
        return k is not None and not any(n.tag in HTML_WITHIN for n in self.open[k + 1 :])

    def handle_starttag(self, tag: str, attrs: list, closed: bool = False) -> None:
        if self.frames:
            return
        attributes = self._attributes(attrs) if attrs else {}
        self.drawn |= tag in FOREIGN
        self.scripted |= tag in ("script", "style")
        if self.begun and self._in_foreign():
            if tag in BREAKS_OUT or tag == "font" and attributes.keys() & {"color", "face", "size"}:
                while self._in_foreign():
                    self.open.pop()
            else:
                self.clear_cdata_mode()
                node = Node(tag, attributes)
                if closed:
                    self._add(node)
                else:
                    self._push(node)
                return
        if tag == "frameset" and not self.begun:
            self.frames = True  # a page of frames has no body
            return
        if tag in RCDATA or tag in RAW:
            self.set_cdata_mode(tag)
        if tag in WHOLE:
            self.begun |= tag == "body"
            return
        if not self.begun:
            if tag in HEAD:
                self.in_head_text = tag in ("title", "script", "style", "noscript")
                return
            self.begun = True
        if tag in CLOSES_P and self._in_scope("p"):
            self._pop_to({"p"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in ("li", "dd", "dt"):
            own = {"li"} if tag == "li" else {"dd", "dt"}
            for n in reversed(self.open):
                if n.tag in own:
                    self._pop_to(own)
                    break
                if n.tag in BLOCKS and n.tag not in ("address", "div", "p"):
                    break
        elif tag in ("option", "optgroup") and self.open[-1].tag == "option":
            self.open.pop()
        elif tag == "table" and self.open[-1].tag in TABLE_CONTEXT:
            self._pop_to({"table"})
        elif tag == "form" and self.open[-1].tag in TABLE_CONTEXT:
            return
        elif tag in WITHIN_TABLE:
            if not any(n.tag == "table" for n in self.open):
                return
            over = WITHIN_TABLE[tag]
            while self.open[-1].tag not in over:
                self._close_cell(self.open.pop())
            if tag in ("td", "th"):
                if self.open[-1].tag != "tr":
                    self._push(Node("tr"))
                self.active.append(None)
            self._push(Node(tag, attributes))
            return
        if tag == "a" and (old := next((n for n in reversed(self.active) if n is None or n.tag == "a"), None)):
            self._end_formatting("a")
            if old in self.active:
                self.active.remove(old)
        if tag not in CLOSES_P and tag not in ("script", "style", "template"):
            self._reopen()
        node = Node(tag, attributes)
        if tag in VOID:
            self._add(node)
            return
        self._push(node)
        if tag in FORMATTING:
            alike = [n for n in self.active if n is not None and n.tag == tag and n.attrs == attributes]
            if len(alike) >= 3:
                self.active.remove(alike[0])
            self.active.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        foreign = tag in FOREIGN
        self.handle_starttag(tag, attrs, closed=True)
        if foreign and self.open[-1].tag == tag and not self.open[-1].children:
            self.open.pop()

    def _end_formatting(self, tag: str) -> None:
        """The end of a formatting element, also of one that isn't innermost: what is misnested is split, and stays formatted up to here."""
        for _ in range(8):
            node = next((n for n in reversed(self.active) if n is None or n.tag == tag), None)
            if node is None:
                if self.open[-1].tag == tag:
                    self.open.pop()
                return
            if node not in self.open:
                self.active.remove(node)
                return
            at = self.open.index(node)
            if any(n.tag in SCOPE for n in self.open[at + 1 :]):
                return
            block = next((k for k in range(at + 1, len(self.open)) if self.open[k].tag in BLOCKS), None)
            if block is None:
                del self.open[at:]
                self.active.remove(node)
                return
            inner = last = self.open[block]
            place = self.active.index(node)
            between = 0
            for k in range(block - 1, at, -1):
                between += 1
                above = self.open[k]
                if above in self.active and between > 3:
                    if self.active.index(above) < place:
                        place -= 1
                    self.active.remove(above)
                if above not in self.active:
                    del self.open[k]
                    continue
                copy = Node(above.tag, above.attrs)
                self.active[self.active.index(above)] = self.open[k] = copy
                if last is inner:
                    place = self.active.index(copy) + 1
                copy.put(last)
                last = copy
            self._add_to(at - 1, last)
            copy = Node(tag, node.attrs)
            copy.children, inner.children = inner.children, []
            for c in copy.children:
                if not isinstance(c, str):
                    c.parent = copy
            inner.put(copy)
            old = self.active.index(node)
            self.active.insert(place, copy)
            del self.active[old + (place <= old)]
            self.open.remove(node)
            self.open.insert(self.open.index(inner) + 1, copy)

    def handle_endtag(self, tag: str) -> None:
        if self.frames:
            return
        if self.begun and self._in_foreign():
            if tag in ("br", "p"):
                while self._in_foreign():
                    self.open.pop()
            else:
                k = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag or self.open[k].tag in FOREIGN), 0)
                if k and self.open[k].tag == tag:
                    del self.open[k:]
                    return
        if not self.begun:
            self.in_head_text = False
            return
        if tag in WHOLE or tag in VOID:
            if tag == "br":
                self.handle_starttag("br", [])
            return
        if tag in FORMATTING:
            self._end_formatting(tag)
        elif tag == "p" and not self._in_scope("p"):
            self._add(Node("p"))
        elif tag in HEADINGS and any(self._in_scope(h) for h in HEADINGS):
            self._pop_to(HEADINGS)
        elif tag == "table" or tag in WITHIN_TABLE:
            if any(n.tag == tag for n in self.open):
                while self.open[-1].tag != tag:
                    self._close_cell(self.open.pop())
                self._close_cell(self.open.pop())
        elif self._in_scope(tag):
            self._pop_to({tag})

    def _close_cell(self, node: Node) -> None:
        if node.tag in ("td", "th") and None in self.active:
            del self.active[len(self.active) - 1 - self.active[::-1].index(None) :]

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA[") and self.begun and self._in_foreign():
            self._add(data[6:])

    def handle_data(self, data: str) -> None:
        if self.frames:
            return
        if not self.begun:
            if self.in_head_text or not data.strip():
                return
            self.begun, data = True, data.lstrip("\t\n\f\r ")
        if self.cdata_elem in RCDATA:
            data = unescape(data)
        elif not self.cdata_elem and data.strip("\t\n\f\r "):
            self._reopen()
        self._add(data)

    def handle_comment(self, data: str) -> None:
        if self.begun:  # nothing to render, but texts around it stay apart
            self.open[-1].children.append(Node("#comment"))

    def feed(self, data: str) -> None:
        """A text of plain tags alone needs no tokenizer that looks for all else."""
        if not _PLAIN.fullmatch(data):
            super().feed(data)
            return
        for end, tag, attributes, text in _PLAIN_TOKEN.findall(data):
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            elif end:
                self.handle_endtag(tag.lower())
            else:
                self.handle_starttag(tag.lower(), _PLAIN_ATTRIBUTE.findall(attributes) if attributes else [])

    def close(self) -> None:
        super().close()
        if self.cdata_elem and self.rawdata:  # raw text that never ends
            self.handle_data(self.rawdata)


def decoded(content: bytes, charset: str | None = None) -> str:
    """Text of an HTML file; names of Latin-1 and ASCII mean windows-1252, and one byte order mark is dropped."""
    label = (charset or "utf-8").strip().lower()
    codec = codecs.lookup(label).name
    return content.decode("cp1252" if codec in ("iso8859-1", "ascii") else codec, "replace").removeprefix("\ufeff")


def _built(html: str) -> TreeBuilder:
    builder = TreeBuilder()
    builder.feed(html.replace("\r\n", "\n").replace("\r", "\n"))
    builder.close()
    return builder


def parse(html: str) -> Node:
    return _built(html).body


def _without(node: Node, tags: set[str]) -> None:
    stack = [node]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or c.tag not in tags]
        stack.extend(c for c in n.children if not isinstance(c, str))


LISTS = {"ul", "ol"}


def _cells(node: Node) -> list[list[str]]:
    """The texts of a table's rows, or of a list's own items, one a row."""
    if node.tag == "table":
        return [[c.text() for c in row.find({"td", "th"})] for row in node.find({"tr"})]
    return [[c.text()] for c in node.children if not isinstance(c, str) and c.tag == "li"]


def blocks(html: str, strip: bool = True) -> dict[str, list]:
    """The body as a flat sequence of blocks, in lists with an entry a block: tag, text, href, cells.

    A text between elements is a block #text. Elements that only hold others are left out, and their content is in
    the sequence. href is an image's source or a link's target, and the text of an image is what stands for it.
    script and style are left out if `strip`. What a block looks like in Markdown is `render.blocks`.
    """
    built = _built(html)
    body = built.body
    if strip and built.scripted:
        _without(body, {"script", "style"})
    tags, texts, hrefs, cells = [], [], [], []
    stack = list(reversed(body.children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            tag, text, href = "#text", n, None
        elif n.tag in CONTAINERS:
            stack.extend(reversed(n.children))
            continue
        elif n.tag == "img":
            tag, text, href = "img", n.attrs.get("alt", ""), n.attrs.get("src")
        elif n.tag == "#comment":
            continue
        else:
            own = n.tag not in LISTS and n.tag != "table"
            tag, text, href = n.tag, n.text() if own else "", n.attrs.get("href")
        tags.append(tag)
        texts.append(text)
        hrefs.append(href)
        cells.append(_cells(n) if tag in LISTS or tag == "table" else None)
    return {"tag": tags, "text": texts, "href": hrefs, "cells": cells}


def nodes(html: str) -> Iterator[tuple[int, int | None, str, str | None, dict[str, str]]]:
    """(node_id, parent_id, tag, text, attrs) of the body and all below it, in document order; texts are nodes #text."""
    stack: list[tuple[Node | str, int | None]] = [(parse(html), None)]
    k = 0
    while stack:
        n, parent = stack.pop()
        if isinstance(n, str):
            yield k, parent, "#text", n, {}
        else:
            yield k, parent, n.tag, None, n.attrs
            stack.extend((c, k) for c in reversed(n.children))
        k += 1
