"""Splits text into words as a tokenizer file says: in Python, and by the tokenizers library where characters are rare."""

from __future__ import annotations

import json
import re
import unicodedata

import regex
from tokenizers import Tokenizer

#: Latin, combining-free, with common punctuation: characters on which Python's tables and the library's agree.
PLAIN = re.compile(r"[^\x00-\x1b\x20-ɏ‐-‧‰-⁞₠-₿]")


def library_tokenizer(definition: str) -> Tokenizer:
    t = Tokenizer.from_str(definition)
    t.no_truncation()
    t.no_padding()
    return t


class Splitter:
    """Words of a text under a definition that is NFC, white space to one blank, lower case, then a split by pattern."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        kinds = [x["type"] for x in (d["normalizer"] or {}).get("normalizers", [])]
        split, level = (d["pre_tokenizer"] or {}).get("pretokenizers", [None, None])
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("the splitter doesn't know this kind of tokenizer file")
        self.words_in = regex.compile(split["pattern"]["Regex"]).findall
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", re.I) if self.special else None
        self.library = library_tokenizer(definition)
        self.bytes_of = {c: b for b, c in byte_letters().items()}

    def chunks(self, text: str) -> list[str] | None:
        """The lower-case parts between white space, if the words of the text are those of its parts; else None."""
        if PLAIN.search(text) or (self.marks is not None and self.marks.search(text)):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.lower().split()

    def pieces(self, text: str) -> list[str | int]:
        """Words as str and special tokens as int, of any text; by the library's own splitter."""
        out: list[str | int] = []
        for part in self.marks.split(text) if self.marks is not None else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        # the pre-tokenizer gives byte letters; turn them back into text
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, w)).decode() for w, _ in found]


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: its own Latin-1 letter, or one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
