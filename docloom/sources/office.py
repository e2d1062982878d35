"""Small readers of Office files: members of a zip archive to arrays of texts."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape
from xml.etree import ElementTree as ET
from xml.parsers import expat

#: Bounds of one document: bytes of an inflated member, cells of a sheet's table.
MAX_MEMBER, MAX_CELLS = 512 << 20, 4_000_000


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _archive(content: bytes) -> zipfile.ZipFile:
    """An archive whose members inflate to MAX_MEMBER bytes at most; reading stops at the size that a member states."""
    z = zipfile.ZipFile(io.BytesIO(content))
    large = next((i.filename for i in z.infolist() if i.file_size > MAX_MEMBER), None)
    if large is not None:
        raise ValueError(f"{large} is too large")
    return z


def _runs(xml: bytes) -> list[str]:
    """The text of each element whose qualified name is a:t, in document order."""
    out: list[str] = []
    open_: list[int] = []
    parser = expat.ParserCreate()  # without namespaces, so that names keep their prefixes

    def start(name: str, _) -> None:
        if name == "a:t":
            open_.append(len(out))
            out.append("")

    def end(name: str) -> None:
        if name == "a:t":
            open_.pop()

    def text(data: str) -> None:
        for k in open_:
            out[k] += data

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.buffer_text = start, end, text, True
    parser.Parse(xml, True)
    return out


def slides(content: bytes) -> list[dict]:
    """(name, texts) of each slide; a malformed slide has no texts."""
    z, out = _archive(content), []
    for name in z.namelist():
        if re.search(r"ppt/slides/slide\d+\.xml", name):
            try:
                texts = _runs(z.read(name))
            except expat.ExpatError:
                texts = []
            out.append({"name": name, "texts": texts})
    return out


def number_text(x: float) -> str:
    """A number as JavaScript prints it."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    t = repr(x)
    m = re.fullmatch(r"(-?[\d.]+)e([+-])0*(\d+)", t)
    if m and m[2] == "-" and int(m[3]) <= 6:
        return f"{x:.20f}".rstrip("0") if float(f"{x:.20f}") == x else t
    return f"{m[1].removesuffix('.0')}e{m[2]}{m[3]}" if m else t


class Cells:
    """The cells of a sheet as they come; a row is kept as its first column and the texts from there on."""

    def __init__(self, name: str | None):
        self.name, self.rows, self.known = name, {}, {}

    def put(self, row: int, column: int, text: str) -> None:
        first, texts = self.rows.setdefault(row, (column, []))
        if column < first:
            texts[:0], first = [""] * (first - column), column
            self.rows[row] = first, texts
        at = column - first
        if at >= len(texts):
            if at > MAX_CELLS:
                raise ValueError(f"Sheet {self.name} spans more than {MAX_CELLS} cells")
            texts.extend([""] * (at + 1 - len(texts)))
        if len(self.known) < 100_000:  # equal texts are one in memory
            text = self.known.setdefault(text, text)
        texts[at] = text

    def table(self) -> list[list[str]]:
        """Rows from the first to the last used one, each from the first used column to its own last cell."""
        if not self.rows:
            return []
        top, bottom = min(self.rows), max(self.rows)
        left, right = min(first for first, _ in self.rows.values()), max(first + len(texts) for first, texts in self.rows.values())
        if (bottom - top + 1) * (right - left) > MAX_CELLS:  # the table is padded to its widest row
            raise ValueError(f"Sheet {self.name} spans more than {MAX_CELLS} cells")
        out = []
        for r in range(top, bottom + 1):
            first, texts = self.rows.pop(r, (left, []))
            out.append([""] * (first - left) + texts if first > left else texts)
        return out


def _events(z: zipfile.ZipFile, member: str, start, end, text) -> None:
    """Calls the handlers with the names and attributes of a member's elements, without prefixes, as it is inflated; no tree is built."""
    parser = expat.ParserCreate()
    local = lambda name: name.rpartition(":")[2]
    parser.StartElementHandler = lambda name, attrs: start(local(name), {local(k): v for k, v in attrs.items()})
    parser.EndElementHandler = lambda name: end(local(name))
    parser.CharacterDataHandler, parser.buffer_text = text, True
    with z.open(member) as f:
        while part := f.read(1 << 16):
            parser.Parse(part)
    parser.Parse(b"", True)


def _strings(z: zipfile.ZipFile) -> list[str]:
    """The texts that cells share, without how they are pronounced."""
    out: list[str] = []
    state = {"text": None, "aside": 0}

    def start(name: str, _) -> None:
        if name == "si":
            state["text"] = []
        elif name == "rPh":
            state["aside"] += 1
        state["in"] = name == "t" and not state["aside"]

    def end(name: str) -> None:
        state["in"] = False
        if name == "si":
            out.append("".join(state["text"] or ()))
        elif name == "rPh":
            state["aside"] -= 1

    def text(data: str) -> None:
        if state.get("in") and state["text"] is not None:
            state["text"].append(data)

    _events(z, "xl/sharedStrings.xml", start, end, text)
    return out


def _column(ref: str) -> tuple[int, int] | None:
    """(row, column) from 0 of a place like B7."""
    m = re.match(r"([A-Z]{1,3})(\d+)", ref)
    column = 0
    for letter in m[1] if m else "":
        column = column * 26 + ord(letter) - 64
    return (int(m[2]) - 1, column - 1) if m else None


def _sheet(z: zipfile.ZipFile, member: str, name: str | None, strings: list[str]) -> list[list[str]]:
    cells = Cells(name)
    row = column = -1
    kind, at, held, aside, taken = "n", None, None, 0, []  # of the open cell; held: the name of the element whose text is taken

    def start(element: str, attrs: dict) -> None:
        nonlocal row, column, kind, at, held, aside, taken
        if element == "row":
            row, column = int(attrs.get("r", row + 2)) - 1, -1
        elif element == "c":
            column += 1
            at = _column(attrs.get("r", "")) or (row, column)
            row, column = at
            kind, taken = attrs.get("t", "n"), []
        elif element == "rPh":
            aside += 1
        elif at and not aside and element == ("t" if kind == "inlineStr" else "v"):
            held = element

    def end(element: str) -> None:
        nonlocal at, held, aside
        if element == held:
            held = None
        elif element == "rPh":
            aside -= 1
        elif element == "c" and at:
            cells.put(*at, _cell(kind, "".join(taken), strings))
            at = None

    def text(data: str) -> None:
        if held:
            taken.append(data)

    _events(z, member, start, end, text)
    return cells.table()


def sheets(content: bytes) -> list[dict]:
    """(name, rows of cell texts) of each sheet in workbook order; false, zero, errors and gaps are empty.

    Sheets are read as they are inflated, so memory holds the texts of the cells, not the XML.
    """
    z = _archive(content)
    names = set(z.namelist())
    strings = _strings(z) if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in (e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"):
        target = targets[_attr(s, "id")].lstrip("/")
        out.append({"name": s.get("name"), "rows": _sheet(z, target if target.startswith("xl/") else f"xl/{target}", s.get("name"), strings)})
    return out


def _cell(kind: str, value: str, strings: list[str]) -> str:
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "true" if value == "1" else ""
    if kind == "n":
        return number_text(float(value)) if value and float(value) else ""
    return "" if kind == "e" else value


def _levels(z: zipfile.ZipFile) -> dict[str, int]:
    """The heading level of each paragraph style that has one: by its name, else the style it is based on, else its outline level."""
    if "word/styles.xml" not in z.namelist():
        return {}
    styles = {}
    for style in (s for s in ET.fromstring(z.read("word/styles.xml")) if _local(s) == "style" and _attr(s, "type") in (None, "paragraph")):
        of = {_local(e): e for e in style}
        outline = next((_attr(e, "val") for e in of.get("pPr", ()) if _local(e) == "outlineLvl"), None)
        value = lambda k, of=of: _attr(of[k], "val") or "" if k in of else ""
        styles[_attr(style, "styleId") or ""] = value("name"), value("basedOn"), outline
    out = {}
    for own in styles:
        at, seen, level = own, set(), None
        while at in styles and at not in seen and level is None:
            seen.add(at)
            name, base, outline = styles[at]
            if m := re.fullmatch(r"(?i)heading ?([1-6])", name):
                level = int(m[1])
            elif outline is not None and outline.isdigit():
                level = int(outline) + 1
            at = base
        if level is not None and level <= 6:
            out[own] = level
    return out


def docx_html(content: bytes) -> str:
    """Paragraphs, headings, bold, italic, links, lists and tables of a Word document as HTML."""
    z = _archive(content)
    body = next(e for e in ET.fromstring(z.read("word/document.xml")).iter() if _local(e) == "body")
    names = set(z.namelist())
    links = {} if "word/_rels/document.xml.rels" not in names else {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
    levels = _levels(z)
    bullets = _bullet_lists(z) if "word/numbering.xml" in names else set()
    noted: list[str | None] = []

    def piece(y: ET.Element) -> str:
        if _local(y) == "footnoteReference":
            noted.append(_attr(y, "id"))
            return f"<sup><a>[{len(noted)}]</a></sup>"
        return escape(y.text or "") if _local(y) == "t" else {"br": "<br>", "tab": "\t"}.get(_local(y), "")

    def inline(e: ET.Element) -> str:
        out = []
        for x in e:
            name = _local(x)
            if name == "r":
                marks = {_local(m): _attr(m, "val") for p in x if _local(p) == "rPr" for m in p}
                t = "".join(map(piece, x))
                for mark, tag in (("i", "em"), ("b", "strong")):
                    if t and mark in marks and marks[mark] not in ("0", "false", "none"):
                        t = f"<{tag}>{t}</{tag}>"
                out.append(t)
            elif name == "hyperlink":
                href = links.get(_attr(x, "id")) or (f"#{_attr(x, 'anchor')}" if _attr(x, "anchor") else None)
                out.append(f'<a href="{escape(href)}">{inline(x)}</a>' if href else inline(x))
            elif name in ("ins", "smartTag", "sdt", "sdtContent"):
                out.append(inline(x))
        return "".join(out)

    def blocks(parent: ET.Element) -> str:
        out, lists = [], []  # kinds of the lists that are open, outermost first; each has an open item

        def close(depth: int) -> None:
            while len(lists) > depth:
                out.append(f"</li></{lists.pop()}>")

        for x in parent:
            if _local(x) == "p":
                marks = {_local(m): m for p in x if _local(p) == "pPr" for m in p}
                style = _attr(marks["pStyle"], "val") or "" if "pStyle" in marks else ""
                by_id = re.fullmatch(r"(?i)heading ?([1-6])", style)
                level = levels.get(style) or (int(by_id[1]) if by_id else None)
                text = inline(x)
                if "numPr" in marks and not level:
                    number = next((_attr(m, "val") for m in marks["numPr"] if _local(m) == "numId"), None)
                    depth = min(int(next((_attr(m, "val") for m in marks["numPr"] if _local(m) == "ilvl"), None) or 0), 8)
                    kind = "ul" if (number, str(depth)) in bullets else "ol"
                    if len(lists) == depth + 1 and lists[-1] == kind:
                        out.append("</li>")
                    else:
                        close(depth + 1 if len(lists) > depth and lists[depth] == kind else depth)
                        if len(lists) == depth + 1:
                            out.append("</li>")
                        while len(lists) <= depth:
                            lists.append(kind)
                            out.append(f"<{kind}>" + ("<li>" if len(lists) <= depth else ""))
                    out.append(f"<li>{text}")
                    continue
                tag = f"h{level}" if level else "p"
                block = f"<{tag}>{text}</{tag}>" if text else ""
            elif _local(x) == "tbl":
                rows = [[blocks(c) for c in r if _local(c) == "tc"] for r in x if _local(r) == "tr"]
                block = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
            elif _local(x) in ("sdt", "sdtContent"):
                block = blocks(x)
            else:
                continue
            close(0)
            out.append(block)
        close(0)
        return "".join(out)

    main = blocks(body)
    told = ""
    if noted and "word/footnotes.xml" in names:
        texts = {_attr(n, "id"): blocks(n) for n in ET.fromstring(z.read("word/footnotes.xml")) if _local(n) == "footnote"}
        told = "<ol>" + "".join(f"<li>{texts.get(n, '')} <a>\u2191</a></li>" for n in noted) + "</ol>"
    return f"<body>{main}{told}</body>"


def _bullet_lists(z: zipfile.ZipFile) -> set[tuple[str | None, str | None]]:
    """(number, level) of the lists whose level has bullets."""
    root = ET.fromstring(z.read("word/numbering.xml"))
    formats = {
        (_attr(a, "abstractNumId"), _attr(level, "ilvl") or "0"): next((_attr(f, "val") for f in level if _local(f) == "numFmt"), None)
        for a in root if _local(a) == "abstractNum" for level in a if _local(level) == "lvl"
    }
    uses = {_attr(n, "numId"): next((_attr(x, "val") for x in n if _local(x) == "abstractNumId"), None) for n in root if _local(n) == "num"}
    return {(n, level) for n, a in uses.items() for (b, level), kind in formats.items() if a == b and kind == "bullet"}
