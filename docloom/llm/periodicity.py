"""Periodic runs: stretches of words that repeat with one period, found on a harmonic grid.

A stretch of period p and length m or more covers floor(m/p) multiples of p in a row. So for each period p the grid
points jp and (j+1)p are compared: the longest common extension of the two, forward by the suffix array of the text
and backward by that of the reversed text, gives the whole stretch around them. Over all p that is n/1 + n/2 + ... =
O(n log n) pairs. An extension is the minimum of neighbours' common prefixes between two places of the suffix array,
asked of a range-minimum table. Pairs that are refuted by a few comparisons (they lack the equal grid points, or differ
within the first words, that a long enough stretch needs) have their answer without the arrays, and a text without
any other pair never builds them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import map_texts, text_of

#: A run has so many words at least, and so many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Grid pairs that are looked at together; they take some 50 bytes each.
BLOCK = 1 << 21
DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_SCHEMA = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


class Extensions:
    """Longest common extensions of two places of an array of ids, by a suffix array and range minima.

    Suffixes are sorted by doubling: ranks by 1, 2, 4, ... words. The ranks of each step also give the common prefixes
    of neighbours, from the widest step down.
    """

    def __init__(self, ids: np.ndarray):
        n = self.n = len(ids)
        rank = ids.astype(np.int64)
        ranks, width = [ids.astype(np.int32)], 1
        base = max(n, int(rank.max(initial=0)) + 1) + 1
        while len(ranks) == 1 or width < n and int(rank.max()) < n - 1:
            after = np.zeros(n, np.int64)  # 0: the text ends before
            after[: n - width] = rank[width:] + 1
            key = rank * base + after
            order = np.argsort(key)
            sorted_ = key[order]
            ascending = np.zeros(n, np.int64)
            np.cumsum(sorted_[1:] != sorted_[:-1], out=ascending[1:])
            rank = np.empty(n, np.int64)
            rank[order] = ascending
            ranks.append(rank.astype(np.int32))
            width *= 2
        self.place = ranks[-1]  # of each suffix in the suffix array
        suffixes = np.empty(n, np.int64)
        suffixes[self.place] = np.arange(n)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            open_ = np.flatnonzero((a < n) & (b < n))
            same = open_[ranks[k][a[open_]] == ranks[k][b[open_]]]
            # equal ranks of a step mean equal words as far as the step goes or the text does
            step = np.minimum(1 << k, n - np.maximum(a[same], b[same]))
            common[same] += step
            a[same] += step
            b[same] += step
        self.common = common.astype(np.int32)  # of the suffixes at places k and k + 1

    def longest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of places i and j, which differ; a place n is the end. Minima over 2^k neighbours are made for one k after the other."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero((i < self.n) & (j < self.n))
        x, y = self.place[i[inside]], self.place[j[inside]]
        low, high = np.minimum(x, y), np.maximum(x, y)  # the minimum over low .. high - 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        by_level = np.argsort(level, kind="stable")
        edges = np.searchsorted(level[by_level], np.arange(level.max(initial=-1) + 2))
        table = self.common
        for k in range(len(edges) - 1):
            if k:
                table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
            own = by_level[edges[k] : edges[k + 1]]
            if len(own):
                out[inside[own]] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        return out


def grid_pairs(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (p, jp): the pairs jp, (j+1)p of a period that may lie in a run.

    A run of period p has m = max(24, 3p) words at least. It covers floor(m / p) grid points in a row, all with the same
    word, and from the first of them its next m - 2p > 7 words come again p later. Pairs that can't be such a first one
    are left out.
    """
    n = len(ids)
    top = n // MIN_PERIODS
    p = 1
    while p <= top:
        # periods p .. q - 1 have at most BLOCK grid points, or there is one period
        sizes = (n - 1) // np.arange(p, min(top, p + BLOCK) + 1) + 1
        q = p + max(1, int(np.searchsorted(np.cumsum(sizes), BLOCK, side="right")))
        sizes = sizes[: q - p]
        q = p + len(sizes)
        periods = np.repeat(np.arange(p, q), sizes)
        first = np.cumsum(sizes) - sizes
        at = (np.arange(len(periods)) - np.repeat(first, sizes)) * periods
        words = ids[at]
        equal = np.zeros(len(at), bool)
        equal[:-1] = (words[:-1] == words[1:]) & (periods[:-1] == periods[1:])
        begins = np.flatnonzero(equal & ~np.concatenate([[False], equal[:-1]]))  # equal pairs in a row
        ends = np.flatnonzero(equal & ~np.concatenate([equal[1:], [False]]))
        enough = (ends - begins + 2) * periods[begins] > np.maximum(MIN_WORDS, MIN_PERIODS * periods[begins]) - periods[begins]
        begins, ends = begins[enough], ends[enough]
        if len(begins):
            lengths = ends - begins + 1
            index = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            period, at = periods[index], at[index]
            for k in range(1, MIN_WORDS // MIN_PERIODS):
                near = at + period + k < n
                period, at = period[near], at[near]
                same = ids[at + k] == ids[at + period + k]
                period, at = period[same], at[same]
            if len(at):
                yield period, at
        p = q


def runs(ids: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and then period."""
    n = len(ids)
    forward = backward = None
    found = [np.empty((3, 0), np.int64)]
    for period, at in grid_pairs(ids):
        if forward is None:
            forward, backward = Extensions(ids), Extensions(ids[::-1])
        ahead = forward.longest(at, at + period)
        behind = backward.longest(n - at, n - at - period)
        length = behind + period + ahead
        long = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
        found.append(_smallest(np.stack([at - behind, length, period])[:, long]))
    start, length, period = _smallest(np.concatenate(found, axis=1))
    return np.stack([start, length, period], axis=1)[np.lexsort((period, start))]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One column a stretch (start, length, period). If several periods have three of theirs in it, they are multiples of the smallest."""
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    return rows[:, fresh]


def word_ids(words: list[bytes]) -> np.ndarray:
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a periodic tail for one id in ten, by a checksum of the id."""
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def _strongest(rows: np.ndarray) -> tuple[int, int, int]:
    """The run of greatest length/period; of equal ones the first, then that of the smallest period."""
    best = None
    for start, length, period in rows.tolist():  # by start, then period
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapsed(words: list[bytes], rows: np.ndarray) -> list[bytes]:
    """Without the words that some run has after its first period."""
    if not len(rows):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edges, rows[:, 0] + rows[:, 1], -1)
    keep = np.cumsum(edges)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def digest(words: list[bytes]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of a text's words."""
    rows = runs(word_ids(words)) if len(words) >= MIN_WORDS else np.empty((0, 3), np.int64)
    best = _strongest(rows) or (None, None, None)
    lines = "".join(f"{start},{length},{period}\n" for start, length, period in rows.tolist())
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return len(rows), *best, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, rows))).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), one row per row of docs.

    Words are what white space of ASCII leaves, compared as they are. start, length, period and exponent_milli are of
    the run with the most periods, and null without runs. collapsed_sha256 is of the text with each run cut to its first
    period. With `plant` the words of one id in ten get a periodic tail first (see `planted`); a null id counts as the
    empty string there. Null and empty texts have no words, so no runs, and the digest of nothing. Repeated rows are all
    returned; an empty table gives an empty result; other columns aren't read. Nothing is shuffled; a text of n words
    takes some 150 n bytes, and its grid pairs a fixed block more.
    """

    def one(ids: pa.Array, texts: list[str]) -> list[list]:
        keys = ids.to_pylist()
        found = []
        for doc_id, text in zip(keys, texts):
            words = text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20 and \x09 to \x0D
            found.append((doc_id, *digest(planted(doc_id, words) if plant else words)))
        return [list(c) for c in zip(*found)] if found else [[]] * len(_SCHEMA)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return map_texts(rows, one, _SCHEMA, DDL)
