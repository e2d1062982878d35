"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the polynomial hash of each prefix, modulo two primes. The hash of any span is a
difference of two entries, so spans are compared in constant time, and the longest common extension of two
positions is found by binary search. A text put together from parts of others takes its entries from their arrays.
The fingerprint is the whole text's hash and length, and a sketch: of all spans of `SPAN` code points the least hash
in each of `BINS` bins. The share of equal bins estimates the share of spans that two texts have in common.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import text_of

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1566083)
SPAN, BINS = 16, 64
#: Long texts are hashed in blocks of so many code points; an array holds 8 bytes a code point, and a block's work 100.
BLOCK = 1 << 20
_EMPTY = np.uint64(0xFFFF)


class Powers:
    """Powers of a base and of its inverse modulo a prime: a table of up to BLOCK of them, and steps of BLOCK."""

    def __init__(self, base: int, prime: int):
        self.p, self.prime = prime, np.uint64(prime)
        self.base, self.inverse = base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < min(n, BLOCK):
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, self.p)) % self.prime])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, self.p)) % self.prime])

    def downs(self, lo: int, hi: int) -> np.ndarray:
        """Powers lo to hi - 1 of the inverse, of one block."""
        at = lo % BLOCK
        out = self.down[at : at + hi - lo]
        return out if lo < BLOCK else out * np.uint64(pow(self.inverse, lo - at, self.p)) % self.prime


_POWERS = [Powers(b, p) for b, p in zip(BASES, PRIMES)]


class Prefixes:
    """Prefix hashes of a text, an array of code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = [np.zeros(self.n + 1, np.uint32) for _ in _POWERS]
        for p, sums in zip(_POWERS, self.sums):
            p.grow(self.n + 1)
            carry = np.uint64(0)
            for lo in range(0, self.n, BLOCK):
                c = codes[lo : lo + BLOCK].astype(np.uint64) + np.uint64(1)
                terms = c * p.up[: len(c)] % p.prime
                if lo:
                    terms = terms * np.uint64(pow(p.base, lo, p.p)) % p.prime
                found = (np.cumsum(terms) + carry) % p.prime  # terms are below 2^31, so sums of a block are exact
                sums[lo + 1 : lo + 1 + len(c)] = found
                carry = found[-1]

    def entries(self, which: int, lo: int, hi: int) -> np.ndarray:
        """Entries lo to hi - 1 of the array of one prime."""
        return self.sums[which][lo:hi].astype(np.uint64)

    def spans(self, lo: int, hi: int, length: int) -> np.ndarray:
        """62-bit hashes of the spans of one length that start from lo to hi - 1; equal spans have equal hashes wherever they start."""
        out = np.zeros(hi - lo, np.uint64)
        for which, p in enumerate(_POWERS):
            d = (self.entries(which, lo + length, hi + length) + p.prime - self.entries(which, lo, hi)) % p.prime
            for at in range(lo - lo % BLOCK, hi, BLOCK):
                a, b = max(at, lo), min(at + BLOCK, hi)
                d[a - lo : b - lo] = d[a - lo : b - lo] * p.downs(a, b) % p.prime
            out = (out << np.uint64(31)) | d
        return out

    def entry(self, which: int, k: int) -> int:
        return int(self.sums[which][k])

    def span(self, start: int, length: int) -> int:
        """As `spans`, of one start."""
        out = 0
        for which, p in enumerate(_POWERS):
            d = (self.entry(which, start + length) - self.entry(which, start)) % p.p
            out = out << 31 | (d * int(p.downs(start, start + 1)[0]) % p.p if start else d)
        return out


class Spliced(Prefixes):
    """The prefix hashes of the first `keep` code points of one text and the first `more` of another, from their arrays."""

    def __init__(self, first: Prefixes, keep: int, then: Prefixes, more: int):
        self.first, self.keep, self.then, self.n = first, keep, then, keep + more
        self.shift = [pow(p.base, keep, p.p) for p in _POWERS]
        for p in _POWERS:
            p.grow(self.n + 1)

    def entry(self, which: int, k: int) -> int:
        if k <= self.keep:
            return self.first.entry(which, k)
        return (self.then.entry(which, k - self.keep) * self.shift[which] + self.first.entry(which, self.keep)) % _POWERS[which].p

    def entries(self, which: int, lo: int, hi: int) -> np.ndarray:
        p, cut = _POWERS[which], self.keep + 1
        own = self.first.entries(which, lo, min(hi, cut))
        if hi <= cut:
            return own
        shift, whole = np.uint64(self.shift[which]), np.uint64(self.first.entry(which, self.keep))
        rest = (self.then.entries(which, max(lo, cut) - self.keep, hi - self.keep) * shift + whole) % p.prime
        return np.concatenate([own, rest]) if lo < cut else rest


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def equal_spans(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    return i + length <= a.n and j + length <= b.n and a.span(i, length) == b.span(j, length)


def longest_common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest equal spans that start at i in a and at j in b."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | Prefixes) -> str:
    """Hex: 16 digits of the whole text's hash, 8 of its length, then 4 a bin. A bin without a span is ffff.

    Texts shorter than a span are one span; an empty text has only empty bins.
    """
    p = Prefixes(code_points(text)) if isinstance(text, str) else text
    head = f"{p.span(0, p.n):016x}{p.n & 0xFFFFFFFF:08x}"
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    size = min(SPAN, p.n)
    starts = p.n - size + 1 if p.n else 0
    for lo in range(0, starts, BLOCK):
        x = _mixed(p.spans(lo, min(lo + BLOCK, starts), size))
        at, value = (x >> np.uint64(58)).astype(np.int64), x & np.uint64((1 << 58) - 1)
        if len(x) < 2048:
            order = np.sort(x)  # bins are the high bits, so the least of a bin comes first
            first = np.flatnonzero(np.diff((order >> np.uint64(58)).astype(np.int64), prepend=-1))
            where = (order[first] >> np.uint64(58)).astype(np.int64)
            least[where] = np.minimum(least[where], order[first] & np.uint64((1 << 58) - 1))
        else:
            np.minimum.at(least, at, value)
    bins = np.where(least == np.iinfo(np.uint64).max, _EMPTY, least % _EMPTY)
    return head + bins.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """From 0 to 1: 1 for equal fingerprints, else the share of bins with a span in either text that are equal."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[24:]), ">u2") for f in (a, b))
    used = (x != 0xFFFF) | (y != 0xFFFF)
    return float((x == y)[used].mean()) if used.any() else 0.0


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, doc_id, hash, text, extra): rows dealt into ranges of (doc_id, hash); each also gets the first row after it.

    Ranges come from approximate quantiles of the ids alone, so texts are shuffled once. An id that is several
    quantiles, as a null one may be, has its rows dealt by ranges of their texts' hashes. The last range gets the
    first row of all. Only the quantiles and one first id and hash a range reach the driver.
    """
    text = text_of(docs, text_col)
    lowest = F.lit(-(1 << 63))
    ids = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash")).withColumn("place", F.coalesce("doc_id", lowest))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("place", [k / n for k in range(1, n)] or [0.5], 10 * n).alias("cuts")).first().cuts or []
    single = sorted(set(cuts))
    times = Counter(cuts)
    before_cut = [0, *accumulate(times[c] for c in single)]
    m = max(1, math.isqrt(len(single)))
    every, coarse = (F.array(*map(F.lit, x)).cast("array<long>") for x in (single, single[m - 1 :: m]))
    lower = lambda array: F.size(F.filter(array, lambda c: c < F.col("place")))
    # cuts below an id, found in two steps of about sqrt(n) comparisons; then how often they are quantiles
    below = lower(coarse) * m + lower(F.slice(every, lower(coarse) * m + 1, m))
    ranges = F.array(*map(F.lit, before_cut)).cast("array<int>")
    part = (F.col("hash").cast("double") / 2.0**64 + 0.5) * (F.get(ranges, F.col("below") + 1) - F.get(ranges, "below") + 1)
    own = F.when(F.get(every, "below") == F.col("place"), F.least(F.floor(part).cast("int"), F.get(ranges, F.col("below") + 1) - F.get(ranges, "below"))).otherwise(0)

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("below", below)
        return rows.withColumn("bucket", (F.get(ranges, "below") + own).cast("int")).drop("below", "place")

    # the first row of each range: null ids come first, then ids and hashes ascend
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash")).alias("first")
    firsts = {r.bucket: (r["first"].doc_id, r["first"].hash) for r in dealt(ids).groupBy("bucket").agg(least).orderBy("bucket").collect()}
    rows = dealt(docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")).withColumn("place", F.coalesce("doc_id", lowest)))
    if not firsts:
        return rows.select("bucket", "doc_id", "hash", "text", F.lit(False).alias("extra"))
    there = list(firsts)
    before = {b: there[k - 1] for k, b in enumerate(there)}  # the first range comes after the last
    width = range(there[-1] + 1)
    heads, digests = (F.array(*(F.lit(firsts[b][k] if b in firsts else None) for b in width)).cast("array<long>") for k in (0, 1))
    befores = F.array(*(F.lit(before.get(b)) for b in width)).cast("array<int>")
    first = F.get(heads, "bucket").eqNullSafe(F.col("doc_id")) & (F.get(digests, "bucket") == F.col("hash"))
    previous = F.when(first, F.get(befores, "bucket"))
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra")), F.struct(previous.alias("bucket"), F.lit(True).alias("extra")))
    return rows.select("doc_id", "hash", "text", F.explode(F.filter(places, lambda p: p.bucket.isNotNull())).alias("p")).select("p.bucket", "doc_id", "hash", "text", "p.extra")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, prefix_edited, prefix_next), one row per row of docs.

    The next document is the one that follows in ascending doc_id, and the first after the last; one document
    alone follows itself. prefix_edited and prefix_next are the lengths of the longest common prefixes of the text
    and the edited or the next one. Null doc_ids come first, and rows of one doc_id are ordered by a hash of their
    text. Null texts are empty. Repeated rows are all kept, one after the other in one task. An empty table gives an
    empty result. Other columns are not read.
    """
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_edited long, prefix_next long"
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("prefix_edited", pa.int64()), ("prefix_next", pa.int64())])

    def row(doc: tuple, after: tuple) -> tuple:
        doc_id, text, own, array = doc
        half = len(text) // 2
        spliced = Spliced(array, len(text) - half, after[3], min(half, len(after[1])))
        of_change = fingerprint(spliced)
        digest = hashlib.sha256(edited(text, after[1]).encode()).hexdigest()
        return doc_id, len(text), digest, own, of_change, likeness(own, of_change), likeness(own, after[2]), longest_common_extension(array, 0, spliced, 0), longest_common_extension(array, 0, after[3], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, ended = None, None, False
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for b, doc_id, text, extra in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if b != bucket:
                        bucket, held, ended = b, None, False
                    if ended:  # more copies of the row after the range
                        continue
                    if held is not None and text == held[1]:
                        doc = (doc_id, *held[1:])
                    else:
                        array = Prefixes(code_points(text))
                        doc = (doc_id, text, fingerprint(array), array)
                    if held is not None:
                        out.append(row(held, doc))
                    held, ended = doc, extra
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    dealt = _dealt(docs, id_col, text_col).repartition("bucket")
    order = ["bucket", "extra", F.col("doc_id").asc_nulls_first(), "hash", "text"]
    return dealt.sortWithinPartitions(*order).select("bucket", "doc_id", "text", "extra").mapInArrow(run, ddl)
