"""BPE encoding by dynamic programming over prefixes, and decoding.

In a BPE encoding, cutting off the last token leaves the encoding of the shorter prefix. So each prefix has
one last token, and it is the one suffix match whose left neighbour - the last token of what is left - could
stand next to it: no merge across their border would have come before the merges that made the two.
A suffix automaton of the vocabulary lists the tokens that end at each position; a pair test picks the one that
fits; back-pointers give the ids. Time is linear in the length of a word, however long.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.automaton import SuffixAutomaton
from docloom.llm.common import list_array, map_texts, text_of, worker_table
from docloom.llm.pretokens import Splitter, byte_letters

END = "￿"
#: Bounds of the tables of a Python worker; words are kept in two generations, and a full one replaces the older.
MAX_WORDS, MAX_PAIRS = 100_000, 150_000


class PrefixBPE:
    def __init__(self, definition: str):
        d = json.loads(definition)
        model = d["model"]
        end = model["end_of_word_suffix"] or ""
        if model["continuing_subword_prefix"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError("the encoder doesn't know this kind of BPE")
        vocab = model["vocab"]
        if max(vocab.values()) >> 20:
            raise ValueError("the vocabulary has more than 2^20 tokens")
        self.token_of = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
        self.text = dict.fromkeys(vocab.values(), "")
        for t, i in vocab.items():
            self.text[i] = t[: -len(end)] + END if end and t.endswith(end) else t
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.tail = END if end else ""
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, left, right
        for n, (a, b) in enumerate(model["merges"]):
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, n)
            self.made.setdefault(vocab[a + b], (n, *pair))
        self.id_of = {t: i for i, t in self.text.items()}
        # tokens that never come out of the merges are left out
        self.automaton = SuffixAutomaton((t, i) for i, t in self.text.items() if self._merged(t) == [i])
        self.pairs: dict[int, bool] = {}

    def _symbols(self, t: str) -> list[int]:
        whole = t.endswith(END) and len(t) > 1
        parts = [*t[:-2], t[-2:]] if whole else list(t)
        return [self.id_of.get(p, -1) for p in parts]

    def _merged(self, t: str) -> list[int]:
        """The merges applied one by one, lowest rank first and leftmost of equals; only to build the automaton."""
        ids = self._symbols(t)
        while len(ids) > 1:
            n, at = min((self.rank.get(p, 1 << 30), k) for k, p in enumerate(zip(ids, ids[1:])))
            if n == 1 << 30:
                break
            ids[at : at + 2] = [self.id_of[self.text[ids[at]] + self.text[ids[at + 1]]]]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b can stand side by side: undo their merges, latest first, and look for an earlier one across the border."""
        first = a << 20 | b
        limit, ok = 1 << 30, True
        while True:
            n = self.rank.get((a, b))
            if n is not None and n < limit:
                ok = False
                break
            left, right = self.made.get(a), self.made.get(b)
            if left is None and right is None:
                break
            if right is None or (left is not None and left[0] > right[0]):
                limit, a = left[0], left[2]
            else:
                limit, b = right[0] + 1, right[1]  # of equal ranks the left one is merged first
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[first] = ok
        return ok

    def word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        s = word.encode().decode("latin-1").translate(self.letters) + self.tail
        a, pairs = self.automaton, self.pairs
        next_, link, longest, ending = a.next, a.link, a.length, a.ending
        last, state, matched = [-1] * len(s), 0, 0
        for at, letter in enumerate(s):
            after = next_[state].get(letter)
            while after is None and state:  # the longest suffix that goes on
                state = link[state]
                matched = longest[state]
                after = next_[state].get(letter)
            if after is None:
                state = matched = 0
                continue
            state, matched = after, matched + 1
            for length, token in ending[state]:
                if length > at:
                    if length <= matched:
                        last[at] = token
                        break
                elif length <= matched and (left := last[at - length]) >= 0:
                    ok = pairs.get(left << 20 | token)
                    if ok or ok is None and self.fits(left, token):
                        last[at] = token
                        break
        found, at = [], len(s) - 1
        while at >= 0:
            found.append(last[at])
            at -= len(self.text[last[at]])
        return found[::-1]


class Codec:
    def __init__(self, definition: str):
        self.splitter, self.bpe = Splitter(definition), PrefixBPE(definition)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the table before this one filled up

    def _keep(self, part: str, packed: bytes) -> bytes:
        if len(part) <= 64:  # longer ones hardly come twice
            if len(self.known) >= MAX_WORDS:
                self.known, self.before = {}, self.known
            self.known[part] = packed
        return packed

    def _word(self, word: str) -> bytes:
        packed = self.known.get(word)
        if packed is not None:
            return packed
        packed = self.before.get(word)
        return self._keep(word, np.array(self.bpe.word(word), "<i4").tobytes() if packed is None else packed)

    def _chunk(self, chunk: str) -> bytes:
        """Words of a part between white space; mostly letters with an end mark, which need no pattern."""
        packed = self.before.get(chunk)
        if packed is None:
            word = chunk.rstrip(".,;:!?")
            if word.isalpha():
                packed = self._word(word) + (self._word(chunk[len(word) :]) if len(word) < len(chunk) else b"")
            else:
                packed = b"".join(map(self._word, self.splitter.words_in(chunk)))
        return self._keep(chunk, packed)

    def encode(self, text: str) -> np.ndarray:
        chunks = self.splitter.chunks(text)
        if chunks is None:
            return np.frombuffer(b"".join([p.to_bytes(4, "little") if type(p) is int else self._word(p) for p in self.splitter.pieces(text)]), "<i4")
        return np.frombuffer(b"".join([self.known.get(c) or self._chunk(c) for c in chunks]), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """A file without a decoder joins tokens with one blank; ids outside the vocabulary are left out."""
        token = self.bpe.token_of
        return " ".join([token[i] for i in ids.tolist() if i in token])


@worker_table
def codec(definition: str) -> Codec:
    """One for each Python worker."""
    return Codec(definition)


def definition_of(spark, path: str):
    """The tokenizer file as a broadcast string; files are a few MB, and larger ones are refused."""
    size = Path(path).stat().st_size
    if size > 32 << 20:
        raise ValueError(f"{path} has {size} bytes; a tokenizer file should have 32 MB at most")
    return spark.sparkContext.broadcast(Path(path).read_text())


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): each whole text encoded, and its ids decoded again.

    `vocabulary` is the path of a tokenizers JSON file, read on the driver. Special tokens in a text get their
    own ids; none are added. A null or blank text has no ids and decodes to an empty string. Null ids of
    documents and repeated rows are kept as they are. An empty table gives an empty result.
    """
    definition = definition_of(docs.sparkSession, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.large_string())])

    def one(keys, texts):
        c = codec(definition.value)
        ids = [c.encode(t.decode()) for t in texts]
        return keys, list_array(ids), [c.decode(i) for i in ids]

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).cast("binary").alias("text"))
    return map_texts(rows, one, schema, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what `encode` returns, row by row; no ids are an empty text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
