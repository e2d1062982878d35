"""A small reader of Outlook messages: streams of a compound file and the properties in them."""

from __future__ import annotations

import codecs
import struct

# Tags of the properties read, and kinds of recipients.
PROPERTIES = {"0037": "subject", "0C1A": "sender_name", "0C1F": "sender_email", "5D01": "sender_smtp", "1000": "body", "1013": "body_html"}
RECIPIENT = {"3001": "name", "3003": "email", "39FE": "smtp"}
KINDS = {1: "to", 2: "cc", 3: "bcc"}
END = 0xFFFFFFFA  # sector numbers from here on are marks


class CompoundFile:
    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("Failed to parse .msg file: not a compound file")
        self.data, self.size = data, 1 << struct.unpack_from("<H", data, 30)[0]
        first_dir, self.cutoff, first_mini, _, next_difat, _ = struct.unpack_from("<I4xIIIII", data, 48)
        if not 128 <= self.size <= 1 << 16:
            raise ValueError("The file's sectors have an odd size")
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < END]
        for _ in range(len(data) // self.size):  # no table of sectors has more parts than the file has sectors
            if next_difat >= END:
                break
            *more, next_difat = struct.unpack_from(f"<{self.size // 4}I", data, (next_difat + 1) * self.size)
            sectors += [s for s in more if s < END]
        else:
            if next_difat < END:
                raise ValueError("The file's table of sectors has no end")
        if len(sectors) > len(data) // self.size:
            raise ValueError("The file's table of sectors has no end")
        self.fat = [n for s in sectors for n in struct.unpack_from(f"<{self.size // 4}I", data, (s + 1) * self.size)]
        mini = self._chain(first_mini)
        self.minifat = struct.unpack(f"<{len(mini) // 4}I", mini)
        self.entries = [self._entry(e) for e in self._slices(self._chain(first_dir), 128)]
        self.ministream = self._chain(self.entries[0][4])

    @staticmethod
    def _slices(data: bytes, n: int) -> list[bytes]:
        return [data[k : k + n] for k in range(0, len(data) - n + 1, n)]

    def _chain(self, s: int) -> bytes:
        out, seen = [], 0
        while s < len(self.fat) and seen <= len(self.fat):
            out.append(self.data[(s + 1) * self.size : (s + 2) * self.size])
            s, seen = self.fat[s], seen + 1
        return b"".join(out)

    @staticmethod
    def _entry(e: bytes) -> tuple:
        length = struct.unpack_from("<H", e, 64)[0]
        left, right, child = struct.unpack_from("<III", e, 68)
        start, size = struct.unpack_from("<II", e, 116)
        return e[: max(0, length - 2)].decode("utf-16-le"), left, right, child, start, size

    def children(self, at: int) -> dict[str, int]:
        out, stack, seen = {}, [self.entries[at][3]], set()
        while stack:
            k = stack.pop()
            if k < len(self.entries) and k not in seen:
                seen.add(k)
                out.setdefault(self.entries[k][0], k)
                stack += self.entries[k][1:3]
        return out

    def stream(self, at: int) -> bytes:
        *_, s, size = self.entries[at]
        if size >= self.cutoff:
            return self._chain(s)[:size]
        out = []
        while s < len(self.minifat) and len(out) * 64 < size:
            out.append(self.ministream[s * 64 : s * 64 + 64])
            s = self.minifat[s]
        return b"".join(out)[:size]


def _codec(page: int) -> str:
    """The codec of a Windows code page; 65001 is UTF-8, and an unknown one is read as windows-1252."""
    name = "utf-8" if page == 65001 else {20127: "ascii", 28591: "latin-1", 28605: "iso8859-15", 20866: "koi8-r"}.get(page, f"cp{page}")
    try:
        return codecs.lookup(name).name
    except LookupError:
        return "cp1252"


def _texts(f: CompoundFile, at: int, wanted: dict[str, str], codec: str = "utf-8") -> dict[str, str]:
    """Texts by the names wanted; those of 8 bits a character are in `codec`."""
    out = {}
    for name, k in f.children(at).items():
        tag, kind = name[12:16], name[16:20]
        if name.startswith("__substg1.0_") and tag in wanted:
            out[wanted[tag]] = f.stream(k).decode("utf-16-le" if kind == "001F" else codec, "replace").rstrip("\0")
    return out


def _fixed(f: CompoundFile, at: int, header: int) -> dict[int, bytes]:
    """Values of fixed length by property tag."""
    k = f.children(at).get("__properties_version1.0")
    data = f.stream(k)[header:] if k is not None else b""
    return {struct.unpack_from("<I", p)[0]: p[8:16] for p in CompoundFile._slices(data, 16)}


def message(content: bytes) -> dict:
    """The fields that `render.email` takes."""
    from datetime import UTC, datetime, timedelta

    f = CompoundFile(content)
    fixed = _fixed(f, 0, 32)
    page = fixed.get(0x3FFD0003) or fixed.get(0x3FDE0003)  # of the message, else of its body
    codec = _codec(struct.unpack("<I", page[:4])[0]) if page else "utf-8"
    mail = _texts(f, 0, PROPERTIES, codec)
    sent = fixed.get(0x00390040)
    if sent:
        moment = datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=struct.unpack("<Q", sent)[0] // 10)
        mail["submit_time"] = moment.strftime("%a, %d %b %Y %H:%M:%S GMT")
    people = []
    for name, k in sorted(f.children(0).items()):
        if name.startswith("__recip_version1.0_"):
            who = _texts(f, k, RECIPIENT, codec)
            kind = struct.unpack("<I", _fixed(f, k, 8).get(0x0C150003, b"\1\0\0\0")[:4])[0]
            people.append({"recip_type": KINDS.get(kind, "to"), "email": who.get("smtp") or who.get("email"), "name": who.get("name")})
    return mail | {"recipients": people}
