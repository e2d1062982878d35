"""Documents to Markdown: detection and routing native, one small reader call a document, rendering native.

Errors are values. Each input row gives one output row.
"""

from __future__ import annotations

import os
import resource
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from docloom.functions import detect, layout, render
from docloom.functions.text import html_title, normalize, or_else
from docloom.operators.registry import UNSUPPORTED, Registry, all_failed, builtins
from docloom.sources import html as html_source

MAIL = "struct<subject:string,sender_name:string,sender_email:string,sender_smtp:string,recipients:array<struct<recip_type:string,email:string,name:string>>,submit_time:string,body_html:string,body:string>"
PARSED = f"converter string, attempts array<struct<converter:string,error:string>>, markdown string, html string, blocks {render.BLOCKS}, pages array<{layout.PAGE}>, slides array<struct<name:string,texts:array<string>>>, sheets array<struct<name:string,rows:array<array<string>>>>, mail {MAIL}"
FAILED = "Conversion failed"  # what an error without a message says
_FIELDS = ("converter", "attempts", "markdown", "html", "blocks", "pages", "slides", "sheets", "mail")
_MAIL_FIELDS = ("subject", "sender_name", "sender_email", "sender_smtp", "recipients", "submit_time", "body_html", "body")


#: Bytes of a scan that one task of readers gets; a table is dealt to at most WAVES tasks a core.
TASK_BYTES, WAVES = 1 << 20, 64
#: A worker holds what it read of so many documents, or of so many bytes of them, before it passes that on.
SLICE_ROWS, SLICE_BYTES = 128, 1 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows, dealt out anew if they come from a scan of fewer partitions than readers need.

    Readers cost far more than a shuffle of what they read. A small table may be one partition, and one of a scan's
    usual size would keep a task busy for long: so a task gets TASK_BYTES of the files, or 1/WAVES of a core's share.
    Streams and plans with a shuffle of their own are left as they are.
    """
    if rows.isStreaming:
        return rows
    cores, execution = rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.queryExecution()
    if execution.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # it has a shuffle or a subquery
        return rows
    size = sum(int(leaf.stats().sizeInBytes()) for leaf in _leaves(execution.optimizedPlan()))
    tasks = max(cores, min(-(-size // TASK_BYTES), WAVES * cores))
    return rows.repartition(tasks) if execution.toRdd().getNumPartitions() < tasks else rows


def _leaves(plan) -> list:
    found = plan.collectLeaves()
    return [found.apply(k) for k in range(found.size())]


def each_row(one: Callable, returns: str, around: Callable[[], AbstractContextManager] = nullcontext):
    """A function of columns that gives one(values) for each row, null for None; tasks call it within `around`.

    Results go on in slices, so that a worker's memory depends on a slice, however many rows a batch has.
    """
    kind = DataType.fromDDL(returns)
    # the parser makes a struct of one field of a type that is none
    kind = kind[0].dataType if isinstance(kind, StructType) and len(kind) == 1 and kind[0].name == "value" else kind
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = (batch,) if isinstance(batch, pa.Array) else batch  # of one column Spark gives the arrays themselves
            for at, n in _slices(columns):
                with around():
                    found = [one(*values) for values in zip(*(c.slice(at, n).to_pylist() for c in columns))]
                yield _array(found, arrow)

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)


def _slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of a batch; a row of many bytes is in one with few others."""
    n, size = len(columns[0]), np.zeros(len(columns[0]), np.int64)
    for c in columns:
        if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_binary(c.type) or pa.types.is_large_string(c.type):
            size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < n:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
        yield at, end - at
        at = end


def _array(found: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array of Python values; a struct may be a tuple of its fields."""
    if not pa.types.is_struct(kind):
        return pa.array(found, kind)
    fields = []
    for k, f in enumerate(kind):
        fields.append(_array([None if x is None else x.get(f.name) if isinstance(x, dict) else x[k] for x in found], f.type))
    return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array([x is None for x in found], pa.bool_()))


def html_blocks(html: Column) -> Column:
    """The blocks of an HTML text, as `render.blocks` takes them; null gives null."""
    return each_row(lambda h: None if h is None else html_source.blocks(h), render.BLOCKS)(html)


def html_to_markdown(html: Column) -> Column:
    """Normalized Markdown of an HTML text; null gives null."""
    return normalize(render.blocks(html_blocks(html)))


@contextmanager
def _limited(seconds: float | None, megabytes: int | None):
    """Gives a function that calls a reader, and raises TimeoutError or MemoryError where it takes more; tasks read in the main thread of their worker.

    The bound of memory is set once for all calls within.
    """

    def ring(*_):
        raise TimeoutError(f"Operation timed out after {seconds:g} s")

    timed = seconds and threading.current_thread() is threading.main_thread()
    space = resource.getrlimit(resource.RLIMIT_AS)
    bounded = megabytes and os.path.exists("/proc/self/statm")
    if bounded:
        with open("/proc/self/statm") as f:
            most = int(f.read().split()[0]) * resource.getpagesize() + (megabytes << 20)
        resource.setrlimit(resource.RLIMIT_AS, (min(x for x in (most, *space) if x != resource.RLIM_INFINITY), space[1]))

    def call(read, *arguments):
        try:
            if timed:
                signal.setitimer(signal.ITIMER_REAL, seconds)
            return read(*arguments)
        except MemoryError:
            raise MemoryError(f"Operation took more than {megabytes} MB") from None
        finally:
            if timed:
                signal.setitimer(signal.ITIMER_REAL, 0)

    before = signal.signal(signal.SIGALRM, ring) if timed else None
    try:
        yield call
    finally:
        if timed:
            signal.signal(signal.SIGALRM, before)
        if bounded:
            resource.setrlimit(resource.RLIMIT_AS, space)


def _reader(registry: Registry, seconds: float | None, megabytes: int | None = None):
    read = {c.name: (c.read, c.charset) for c in registry.ordered()}
    calls: list = []

    @contextmanager
    def limits():
        with _limited(seconds, megabytes) as call:
            calls[:] = [call]
            yield

    def first_success(candidates: list[str], content: bytes | None, charset: str | None) -> tuple | None:
        if content is None:
            return None
        attempts = []
        for name in candidates:
            try:
                one, takes_charset = read[name]
                found = calls[0](one, content, charset) if takes_charset else calls[0](one, content)
            except Exception as e:  # a document that can't be read is a row with an error
                attempts.append({"converter": name, "error": str(e) or FAILED})
                continue
            if found.get("mail"):
                found["mail"] = {k: found["mail"].get(k) for k in _MAIL_FIELDS}
            found |= {"converter": name, "attempts": attempts}
            return tuple(found.get(k) for k in _FIELDS)
        return tuple({"attempts": attempts}.get(k) for k in _FIELDS)

    return each_row(first_success, f"struct<{PARSED}>", limits)


def error_text(error: Column) -> Column:
    """The text of an error; one without a message says that the conversion failed."""
    return or_else(error, F.lit(FAILED))


OUTCOME = ("converter", "markdown", "title", "error_kind", "error", "attempts")


def document(p: Column, filename: Column) -> dict[str, Column]:
    """What became of a document whose reader gave p (see PARSED): a column for each name of OUTCOME."""
    markdown = (
        F.when(p["markdown"].isNotNull(), p["markdown"])
        .when(p["blocks"].isNotNull(), render.blocks(p["blocks"]))
        .when(p["pages"].isNotNull(), render.pages(layout.pages(p["pages"])))
        .when(p["slides"].isNotNull(), render.deck(p["slides"]))
        .when(p["sheets"].isNotNull(), render.workbook(p["sheets"]))
        .when(p["mail"].isNotNull(), render.email(p["mail"]))
    )
    failed = p["converter"].isNull()
    title = F.when(p["html"].isNotNull(), html_title(p["html"])).when(p["mail"].isNotNull(), or_else(p["mail"]["subject"], filename)).when(~failed, filename)
    return {
        "converter": p["converter"], "markdown": normalize(markdown), "title": title, "error_kind": F.when(failed, "FileConversionException"),
        "error": F.when(failed, all_failed(p["attempts"])), "attempts": p["attempts"],
    }


def converted(files: DataFrame, registry: Registry | None = None, filename: str = "filename", content: str = "content", declared: str | None = None, charset: str | None = None, error: str | None = None, seconds: float | None = 300, megabytes: int | None = 2048) -> DataFrame:
    """Adds extension, mimetype, converter, markdown, title, status, error_kind, error, attempts to the rows of files.

    The first candidate that reads the document wins. Without candidates, or if all fail, markdown is null and
    error says why. Rows without candidates never reach Python: they are split off by a filter. `declared` and
    `charset` name columns, and so does `error`, where it isn't null, why a file has no content. A reader that takes longer than `seconds` or more memory than `megabytes` besides what its
    worker has fails for that document; None switches a bound off.
    """
    registry = registry or builtins()
    own = [c for c in files.columns if c not in (content, error)]
    unread = F.col(error) if error else F.lit(None).cast("string")
    rows = files.withColumn("extension", detect.extension(F.coalesce(F.col(filename), F.lit(""))))
    rows = rows.withColumn("mimetype", detect.mimetype(F.coalesce(F.col(filename), F.lit("")), F.col(declared) if declared else F.lit("")))
    rows = rows.withColumn("candidates", registry.candidates(F.col("extension"), F.col("mimetype")))
    taken = registry.accepts(F.col("extension"), F.col("mimetype"))
    # whether a row has content is left to its reader: a filter on it would compute what makes the content twice
    parsed = spread(rows.where(taken)).withColumn("parsed", _reader(registry, seconds, megabytes)("candidates", content, F.col(charset) if charset else F.lit(None).cast("string")))
    read = F.col("parsed").isNotNull()
    none = F.lit(None).cast("string")
    nothing = {
        "converter": none, "markdown": none, "title": none, "error_kind": F.when(unread.isNotNull(), "FileConversionException").otherwise("UnsupportedFormatException"),
        "error": F.coalesce(unread, F.lit(UNSUPPORTED)), "attempts": F.array().cast("array<struct<converter:string,error:string>>"),
    }
    outcome = document(F.col("parsed"), F.col(filename))
    done = parsed.select(*own, "extension", "mimetype", *(F.when(read, outcome[c]).otherwise(nothing[c]).alias(c) for c in OUTCOME))
    refused = rows.where(~taken).select(*own, "extension", "mimetype", *(nothing[c].alias(c) for c in OUTCOME))
    return done.unionByName(refused).withColumn("status", status(F.col("markdown"), F.col("error")))


def status(markdown: Column, error: Column, loading: Column | None = None) -> Column:
    from docloom.functions.text import utf16_length

    out = F.when(F.coalesce(loading, F.lit(False)), "Converting...") if loading is not None else F.when(F.lit(False), "")
    return out.when(error.isNotNull(), "Failed").when(markdown.isNotNull(), F.concat(F.format_number(utf16_length(markdown), 0), F.lit(" characters"))).otherwise("Pending")


def file_count(files: DataFrame) -> DataFrame:
    """(n, label): '1 file', '2 files'."""
    n = F.count("*")
    return files.agg(n.alias("n"), F.concat(n.cast("string"), F.when(n == 1, " file").otherwise(" files")).alias("label"))


def appended(batch: DataFrame, more: DataFrame, pos: str = "pos") -> DataFrame:
    """The rows of `more` after those of `batch`; positions are numbered from 0 in either."""
    size = batch.agg(F.coalesce(F.max(pos) + 1, F.lit(0)).alias("_size"))
    return batch.unionByName(more.crossJoin(F.broadcast(size)).withColumn(pos, (F.col(pos) + F.col("_size")).cast(batch.schema[pos].dataType)).drop("_size"))


def removed(batch: DataFrame, position: int, pos: str = "pos") -> DataFrame:
    """Without the row at a position; those after it move up by one."""
    return batch.where(F.col(pos) != position).withColumn(pos, (F.col(pos) - (F.col(pos) > position).cast("int")).cast(batch.schema[pos].dataType))


class UnconfiguredLLM:
    """Hooks for images and audio, until a client is given."""

    def describe_image(self, data: bytes) -> str:
        raise NotImplementedError("LLM client not configured")

    def transcribe_audio(self, data: bytes) -> str:
        raise NotImplementedError("LLM client not configured")
