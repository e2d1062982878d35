"""Language identification by string kernels.

A text is the set of its n-grams of one to `LONGEST` signs (letters, and one sign for whatever stands between words).
The blended-spectrum presence kernel of two texts is the number of n-grams, of all lengths, that both have, over the
geometric mean of their own numbers. Nystrom's method writes it in coordinates: the kernels with a few landmark texts
times the inverse root of the landmarks' own kernel matrix. On those a ridge regression is solved for each language
against the rest. Fitted on a bounded sample of labelled texts, the model is a row of weights for each n-gram of a
landmark; since K(x, L) A = P(x) (P(L)' A), a batch of texts is scored by one sparse product of their presence rows
with that matrix, over every n-gram of the whole texts.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import map_texts, text_of, written

LONGEST = 4
UNKNOWN = "und"
DDL = "doc_id long, held_out boolean, lang_pred string, score double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


@lru_cache(maxsize=1)
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """The sign of each code point, 0 for what isn't in a word, and whether it is a letter.

    a to z are 1 to 26; other letters and marks share 229 signs by code point, lower-cased, so those of one alphabet
    differ. There are no letters from U+40000 on.
    """
    signs, letter = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    for cp in range(0x40000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            low = ord(chr(cp).lower()[0])
            signs[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 229
            letter[cp] = kind == "L"
    return signs, letter


def longest_grams(text: str) -> np.ndarray | None:
    """The distinct runs of `LONGEST` signs, sorted, one byte a sign, padded at the end of the text; None for a text without a letter."""
    signs, letter = _signs()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not letter[codes].any():
        return None
    s = np.zeros(len(codes) + 2, np.uint32)
    s[1:-1] = signs[codes]
    between = np.ones(len(s), bool)
    between[1:] = (s[1:] != 0) | (s[:-1] != 0)  # one 0 between words, at the start and at the end
    s = np.concatenate([s[between], np.zeros(LONGEST - 1, np.uint32)])
    return _distinct(s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:])


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    fresh = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=fresh[1:])
    return codes[fresh]


def spectrum(longest: np.ndarray) -> list[np.ndarray]:
    """The distinct n-grams of each length, from 1 on, sorted. Shorter ones are the beginnings of longer ones.

    The sign between words stands at an end of an n-gram only, and isn't one by itself.
    """
    out, codes = [], longest
    for n in range(LONGEST, 0, -1):
        keep = codes != 0
        for k in range(1, n - 1):
            keep &= (codes >> 8 * k) & 0xFF != 0
        out.append(codes[keep])
        codes = codes >> 8
        codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])]
    return out[::-1]


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)  # sorted
    grams: list[np.ndarray] = field(default_factory=list)  # of each length, those of the landmarks, sorted
    weights: list[np.ndarray] = field(default_factory=list)  # a row for each of them, a column a language
    bias: np.ndarray | None = None

    def outputs(self, spectra: list[list[np.ndarray]]) -> np.ndarray:
        """[text, language]: each language's regression, about 1 for its own texts and 0 for others."""
        total = np.zeros((len(spectra), len(self.languages)))
        for n, (known, weights) in enumerate(zip(self.grams, self.weights)):
            if not len(known):
                continue
            codes = np.concatenate([s[n] for s in spectra])
            owner = np.repeat(np.arange(len(spectra)), [len(s[n]) for s in spectra])
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            hit = known[at] == codes
            at, owner = at[hit], owner[hit]
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner, weights[at, k], len(spectra))
        return total / np.sqrt([sum(map(len, s)) for s in spectra])[:, None] + self.bias

    def predictions(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of the greatest output, of equal ones the first by name, and that output from 0 to 1."""
        longest = [longest_grams(t) if self.languages else None for t in texts]
        there = [k for k, grams in enumerate(longest) if grams is not None]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if there:
            outputs = self.outputs([spectrum(longest[k]) for k in there])
            for k, best, value in zip(there, outputs.argmax(axis=1).tolist(), outputs.max(axis=1).tolist()):
                names[k], scores[k] = self.languages[best], min(1.0, max(0.0, value))
        return names, scores


def _presence(spectra: list[list[np.ndarray]], grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of each known n-gram of each text."""
    texts, columns, first = [], [], 0
    for n, known in enumerate(grams):
        for t, s in enumerate(spectra):
            at = np.searchsorted(known, s[n])
            at[at == len(known)] = 0
            at = at[known[at] == s[n]] if len(known) else at[:0]
            texts.append(np.full(len(at), t))
            columns.append(at + first)
        first += len(known)
    return np.concatenate(texts), np.concatenate(columns)


def kernels(spectra: list[list[np.ndarray]], landmarks: list[list[np.ndarray]], grams: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """[text, landmark]: the normalized kernel, by products of presence blocks of so many n-grams."""
    width = sum(map(len, grams))
    ours, theirs = _presence(spectra, grams), _presence(landmarks, grams)
    out = np.zeros((len(spectra), len(landmarks)))
    orders = [np.argsort(columns, kind="stable") for _, columns in (ours, theirs)]
    for at in range(0, width, block):
        sides = []
        for (texts, columns), order, size in zip((ours, theirs), orders, out.shape):
            lo, hi = np.searchsorted(columns[order], [at, at + block])
            side = np.zeros((size, block), np.float32)
            side[texts[order[lo:hi]], columns[order[lo:hi]] - at] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    sizes = [np.sqrt([max(1, sum(map(len, s))) for s in x]) for x in (spectra, landmarks)]
    return out / np.outer(*sizes)


def solved(languages: list[str], spectra: list[list[np.ndarray]], landmarks: int, ridge: float) -> LanguageModel:
    """The model of texts with a language each; their order decides which are landmarks: the first of each language, in turn."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel()
    turn: dict[str, int] = {}
    places = []
    for k, lang in enumerate(languages):
        turn[lang] = turn.get(lang, -1) + 1
        places.append((turn[lang], lang, k))
    chosen = [spectra[k] for *_, k in sorted(places)[:landmarks]]
    grams = [_distinct(np.concatenate([s[n] for s in chosen])) for n in range(LONGEST)]
    own = kernels(chosen, chosen, grams)
    values, vectors = np.linalg.eigh(own)
    firm = values > 1e-6 * values[-1]
    root = vectors[:, firm] / np.sqrt(values[firm])  # [landmark, coordinate]
    x = kernels(spectra, chosen, grams) @ root
    y = np.array([[lang == name for name in names] for lang in languages], float)
    # each language counts alike, however many texts it has
    weight = (1 / y.sum(axis=0))[y.argmax(axis=1)]
    weight /= weight.sum()
    middle, mean = weight @ x, weight @ y
    centred = x - middle
    solution = np.linalg.solve((centred * weight[:, None]).T @ centred + ridge * np.eye(x.shape[1]), (centred * weight[:, None]).T @ (y - mean))
    dual = root @ solution  # [landmark, language]
    weights = []
    for n, known in enumerate(grams):
        w = np.zeros((len(known), len(names)), np.float32)
        for s, row in zip(chosen, dual):
            w[np.searchsorted(known, s[n])] += row / np.sqrt(sum(map(len, s)))
        weights.append(w)
    return LanguageModel(names, grams, weights, mean - middle @ solution)


def is_held_out(doc_id: Column, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % fold == 2


def training_texts(docs: DataFrame, trained_on: Column, max_labelled: int, max_languages: int, max_chars: int, text_col: str, lang_col: str) -> DataFrame:
    """(lang, hash, text): at most `max_labelled` different texts, evenly over the `max_languages` most frequent languages.

    Texts are drawn by their hashes, so copies count once, and copies are dropped before they are shuffled. A text of
    over `max_chars` isn't drawn; that bounds what is learned from, not what is scored.
    """
    rows = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & trained_on & (F.length(docs[text_col]) <= max_chars))
    rows = rows.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")).where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    found = counts.collect()
    each = max(1, max_labelled // max(1, len(found)))
    # about twice as many as wanted are drawn by a threshold; the count is right within a few hundredths
    share = F.create_map(*(F.lit(x) for r in found for x in (r.lang, min(1.0, 2.0 * (each + 20) / r.n)))) if found else F.create_map().cast("map<string,double>")
    drawn = rows.where(F.pmod("hash", F.lit(1 << 40)) / float(1 << 40) < F.try_element_at(share, F.col("lang")))
    drawn = drawn.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    return drawn.withColumn("place", place).where(F.col("place") <= each).drop("place")


def fit(docs: DataFrame, trained_on: Column, text_col: str = "text", lang_col: str = "lang", max_labelled: int = 2000, max_languages: int = 200, max_chars: int = 20_000, landmarks: int = 240, ridge: float = 1e-4) -> LanguageModel:
    """A model from texts where `trained_on` (a condition on docs) holds.

    Tasks turn the sampled texts into their distinct longest n-grams, of which the driver gets 4 * max_labelled *
    max_chars bytes at the very most, and solves the regression in `landmarks` coordinates.
    """
    schema = pa.schema([("lang", pa.string()), ("grams", pa.binary())])

    def longest(keys: pa.Array, texts: list[str]) -> list:
        return [keys, [g if g is None else g.tobytes() for g in map(longest_grams, texts)]]

    drawn = training_texts(docs, trained_on, max_labelled, max_languages, max_chars, text_col, lang_col)
    drawn = written(map_texts(drawn.select("lang", "text"), longest, schema, "lang string, grams binary"), "langid")
    drawn = drawn.where("grams is not null").orderBy(F.xxhash64("grams"), "grams", "lang").collect()
    return solved([r.lang for r in drawn], [spectrum(np.frombuffer(r.grams, "<u4")) for r in drawn], landmarks, ridge)


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 4, **fitting) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of docs.

    Rows whose crc32(id as text) mod `fold` is 2 are held out of training; a null id counts as empty text there. Null
    texts and texts without a letter are `und` with score 0, and so are all if nothing has a language to learn from.
    Otherwise lang_pred is a language that was learned, of equal outputs the first by name, and score its output cut
    to 0 and 1. Repeated rows are all returned; an empty table gives an empty result. Other columns are no input.
    """
    held_out = is_held_out(docs[id_col], fold)
    model = fit(docs, ~held_out, text_col, lang_col, **fitting)

    def one(keys: pa.Array, texts: list[str]) -> list:
        names, scores = model.predictions(texts)
        return [keys.field(0), keys.field(1), names, scores]

    rows = docs.select(F.struct(docs[id_col].cast("long").alias("doc_id"), held_out.alias("held_out")).alias("key"), text_of(docs, text_col).alias("text"))
    return map_texts(rows, one, _SCHEMA, DDL)
