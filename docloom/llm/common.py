"""What the operators share: tables, scratch space, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="docloom-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, else the warehouse; in local mode a temporary one.

    On a cluster a warehouse on each machine's own disk is an error.
    """
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not shared and re.fullmatch(r"local(\[[^\]]*\])?", master):
        shared = f"file://{_own_folder()}"
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        if re.match(r"file:|/", shared) and not master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


_collecting: ContextVar[tuple[list[str], ...]] = ContextVar("collecting", default=())


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that `written` makes meanwhile."""
    made: list[str] = []
    token = _collecting.set((*_collecting.get(), made))
    try:
        yield made
    finally:
        _collecting.reset(token)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """df, written once to shared storage and read from there: no task recomputes it, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    for made in _collecting.get():
        made.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What may be broadcast: so many cells of some 10 bytes, at any size of the input.
MAX_BROADCAST_CELLS = 2_000_000


def small(df: DataFrame, cells: Column | None = None) -> DataFrame:
    """df, a written table, with a hint to broadcast it if it has few cells (a row has `cells`, or its columns); else df."""
    n = df.agg(F.coalesce(F.sum(cells if cells is not None else F.lit(len(df.columns))), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= MAX_BROADCAST_CELLS else df


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, hot_rows: int = 5000, most: int = 10_000) -> DataFrame:
    """left joined with right (one row a key, and n, about how many rows of left have it) on keys, n left out.

    Keys with many rows of left are dealt out by `salt`, a hash of left's columns, and their rows of right are
    copied as often. A key is hot from `hot_rows` rows and a share of 1/most of all on, so at most `most` hot keys
    are broadcast.
    """
    least = right.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / most
    hot = right.where(F.col("n") >= max(hot_rows, least)).select(*keys, F.ceil(F.col("n") / F.lit(max(hot_rows, least))).cast("int").alias("_parts"))
    hot = F.broadcast(hot)
    part = F.pmod(salt, F.coalesce("_parts", F.lit(1))).cast("int")
    left = left.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    right = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts", "n")
    return left.join(right, [*keys, "_part"]).drop("_part")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of so many rows at most for the jobs that run meanwhile; for rows with long lists."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile delete their shuffle files when they end, and not when the driver's memory is collected.

    For results that are written or collected: what reads them later reads no shuffle.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_tables: list = []


def worker_table(make: Callable) -> Callable:
    """make, called once in each Python worker for the same argument; what it makes stays until `tables_dropped`."""
    kept = lru_cache(maxsize=2)(make)
    _tables.append(kept)
    return kept


def tables_dropped() -> None:
    """Drops what a Python worker keeps of other operators; for tasks that need their memory for rows."""
    for kept in _tables:
        kept.cache_clear()


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(docs[text_col], F.lit(""))


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then the words [^\\x20\\x09-\\x0D]+ as an array; native."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def map_texts(rows: DataFrame, one: Callable[[list, list[bytes]], list[list]], schema: pa.Schema, ddl: str) -> DataFrame:
    """rows has (key, text); `one` gets the keys and texts of a slice of a batch and returns the output columns.

    Slices are small, so a batch of very long texts is never copied into Python objects at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = one(part.column(0), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


def list_array(rows: list[np.ndarray]) -> pa.Array:
    """One Arrow list for each int32 array."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows]), pa.int32()))
