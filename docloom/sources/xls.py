"""A small reader of the cells of Excel 97 to 2003 workbooks (BIFF8 records in a compound file)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from docloom.sources.mail import CompoundFile
from docloom.sources.office import Cells, number_text

# The kinds of records that are read.
BOF, EOF, CONTINUE, FILEPASS, BOUNDSHEET, SST = 0x809, 0x0A, 0x3C, 0x2F, 0x85, 0xFC
LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(kind, parts): a record and those that continue it."""
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        parts = [data[at + 4 : at + 4 + size]]
        at += 4 + size
        while kind not in (CONTINUE, BOF) and data[at : at + 2] == b"\x3c\0":
            size = struct.unpack_from("<H", data, at + 2)[0]
            parts.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        yield kind, parts


class _Reader:
    """Strings that may go on in the next part, which then starts with a new byte of flags."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.part, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise ValueError("A string of the workbook is cut off")
            more = self.parts[self.part][self.at : self.at + n - len(out)]
            out, self.at = out + more, self.at + len(more)
        return out

    def text(self, length: int) -> str:
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out: list[str] = []
        while length:
            if self.at >= len(self.parts[self.part]):
                flags = flags & ~1 | self.take(1)[0] & 1
            width = 1 + (flags & 1)
            n = min(length, (len(self.parts[self.part]) - self.at) // width)
            if not n:
                raise ValueError("A string of the workbook is cut off")
            out.append(self.take(n * width).decode("utf-16-le" if width == 2 else "latin-1", "replace"))
            length -= n
        for rest in (4 * runs, extra):
            self.take(rest)
        return "".join(out)


def _rk(data: bytes) -> float:
    n = struct.unpack("<i", data)[0]
    value = float(n >> 2) if n & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<i", n & ~3))[0]
    return value / 100 if n & 1 else value


def _number(x: float) -> str:
    return number_text(x) if x and x == x else ""


def _cells(data: bytes, at: int, strings: list[str], name: str) -> list[list[str]]:
    cells = Cells(name)
    waiting: tuple[int, int] | None = None  # the formula whose text comes next

    put = cells.put
    depth = 0
    for kind, parts in _records(data, at):
        d = parts[0]
        depth += (kind == BOF) - (kind == EOF)
        if depth < 1:
            break
        if depth > 1:  # a chart within the sheet
            continue
        if kind == STRING and waiting:
            put(*waiting, _Reader(parts, 2).text(struct.unpack_from("<H", d)[0]))
        if kind not in (LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA):
            continue
        row, column = struct.unpack_from("<HH", d)
        if kind == LABELSST:
            put(row, column, strings[struct.unpack_from("<I", d, 6)[0]])
        elif kind == LABEL:
            put(row, column, _Reader(parts, 8).text(struct.unpack_from("<H", d, 6)[0]))
        elif kind == NUMBER:
            put(row, column, _number(struct.unpack_from("<d", d, 6)[0]))
        elif kind == RK:
            put(row, column, _number(_rk(d[6:10])))
        elif kind == MULRK:
            for k in range((len(d) - 6) // 6):
                put(row, column + k, _number(_rk(d[6 + 6 * k : 10 + 6 * k])))
        elif kind == BOOLERR:
            put(row, column, "true" if d[6] and not d[7] else "")
        else:
            result, waiting = d[6:14], None
            if result[6:] != b"\xff\xff":
                put(row, column, _number(struct.unpack("<d", result)[0]))
            elif result[0] == 0:
                waiting = row, column
                put(row, column, "")
            else:
                put(row, column, "true" if result[0] == 1 and result[2] else "")
    return cells.table()


def sheets(content: bytes) -> list[dict]:
    """(name, rows of cell texts) of each worksheet, as `office.sheets`."""
    f = CompoundFile(content)
    streams = {name.lower(): k for name, k in f.children(0).items()}
    if "workbook" not in streams:
        raise ValueError("No workbook of Excel 97 or later")
    data = f.stream(streams["workbook"])
    found, strings = [], []
    for kind, parts in _records(data):
        if kind == EOF:
            break
        if kind == FILEPASS:
            raise ValueError("File is password-protected")
        if kind == BOUNDSHEET and parts[0][5] == 0:
            found.append((_Reader(parts, 7).text(parts[0][6]), struct.unpack_from("<I", parts[0])[0]))
        elif kind == SST:
            reader = _Reader(parts, 8)
            strings = [reader.text(struct.unpack("<H", reader.take(2))[0]) for _ in range(struct.unpack_from("<I", parts[0], 4)[0])]
    return [{"name": name, "rows": _cells(data, at, strings, name)} for name, at in found]
