"""Token ids in Parquet files: lists of ids in document order, with small row groups and page indexes.

A file set has the columns doc_id, part, local_start, n_tokens, ids. Parts follow one another in ascending
doc_id; local_start counts the ids of the part's earlier documents. Ids are dictionary-encoded, and counters
and doc_ids delta-encoded. Readers take columns (`metadata` never touches ids) and ranges of doc_id: row groups
and pages outside the range are skipped by the statistics and the page index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.bpe import definition_of
from docloom.llm.common import list_array, text_of
from docloom.llm.pretokens import Splitter, byte_letters, library_tokenizer

FIELDS = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
MAX_CHUNKS = 250_000
#: Up to so many parts (of 12 bytes) their starts are broadcast to the rows; beyond, they are joined by a shuffle.
MAX_PARTS = 1_000_000


class LibraryEncoder:
    """The tokenizers library; its model meets each word once, and words that come again are looked up in a bounded table."""

    def __init__(self, definition: str):
        self.library = library_tokenizer(definition)
        try:
            self.splitter = Splitter(definition)
        except ValueError:
            self.splitter = None
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.packed = [i.to_bytes(4, "little") for i in range(1 + max(self.library.get_vocab().values()))]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the table before this one filled up

    def _keep(self, part: str, ids: bytes) -> bytes:
        if len(part) <= 64:  # longer ones hardly come twice
            if len(self.known) >= MAX_CHUNKS:
                self.known, self.before = {}, self.known
            self.known[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is not None:
            return ids
        ids = self.before.get(word)
        if ids is None:
            letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.packed[t.id] for t in self.library.model.tokenize(letters)])
        return self._keep(word, ids)

    def _chunk(self, chunk: str) -> bytes:
        """Words of a part between white space; mostly letters with an end mark, which need no pattern."""
        ids = self.before.get(chunk)
        if ids is None:
            word = chunk.rstrip(".,;:!?")
            if word.isalpha():
                ids = self._word(word) + (self._word(chunk[len(word) :]) if len(word) < len(chunk) else b"")
            else:
                ids = b"".join(map(self._word, self.splitter.words_in(chunk)))
        return self._keep(chunk, ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for text in texts:
            chunks = self.splitter.chunks(text) if self.splitter is not None else None
            if chunks is None:
                ids = np.array(self.library.encode(text, add_special_tokens=False).ids, "<i4").tobytes()
            else:
                ids = b"".join([self.known.get(c) or self._chunk(c) for c in chunks])
            out.append(ids)
        return out


@lru_cache(maxsize=1)
def library_encoder(definition: str) -> LibraryEncoder:
    """One for each Python worker."""
    return LibraryEncoder(definition)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", row_group_mb: int = 16, page_kb: int = 64, page_rows: int = 500) -> None:
    """Encodes whole texts and writes them in ascending doc_id; rows of one doc_id follow each other by text.

    `end_id` is appended to each document (None: nothing is). A null or blank text has only the end id. Rows with
    a null doc_id come first. Repeated rows are all kept. An empty table writes an empty file set.
    """
    definition = definition_of(docs.sparkSession, vocabulary)
    tail = b"" if end_id is None else np.array([end_id], "<i4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = library_encoder(definition.value), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(b + tail, "<i4") for b in encoder.encode(part.column(2).to_pylist())]
                sizes = np.array([len(i) for i in ids], np.int64)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(starts), pa.array(sizes), list_array(ids)], schema=schema)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", F.spark_partition_id().alias("part"), "text")
    options = {
        "parquet.block.size": row_group_mb << 20,
        "parquet.page.size": page_kb << 10,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#local_start": "false",
        "compression": "zstd",
    }
    rows.mapInArrow(run, FIELDS).write.options(**options).parquet(path)


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in the parts before it; one row a part, so one task sorts as many rows as there are parts, some 100,000 for 100 TB."""
    sizes = spark.read.schema(FIELDS).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(F.col("part").alias("base_part"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The rows with first <= doc_id <= last (all without bounds), and only the wanted columns of the files.

    With a bound, rows with a null doc_id are left out. Repeated rows are all returned, each with its own start; an
    empty file set gives an empty result.
    """
    rows = spark.read.schema(FIELDS).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    if "start" in columns:
        starts = _starts(spark, path)
        if starts.count() <= MAX_PARTS:
            starts = F.broadcast(starts)
        rows = rows.join(starts, F.col("part") == F.col("base_part")).withColumn("start", F.col("base") + F.col("local_start"))
    return rows.select(*columns)


def metadata(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens) as `read`, without reading ids."""
    return read(spark, path, first, last, ("doc_id", "start", "n_tokens"))


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what `read` returns, row by row; no ids have the sum 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            edges = np.asarray(ids.offsets) - (np.asarray(ids.offsets)[0] if len(ids) else 0)
            flat = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sums, pa.int64())], schema=schema)

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
