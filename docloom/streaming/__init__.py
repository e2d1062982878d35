"""Documents as they arrive in a folder; each file is converted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.convert import converted
from docloom.operators.registry import Registry
from docloom.sources.files import filename_of, stream_markdown

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", max_files).load(path)
    return files.select("path", "length", filename_of(F.col("path")).alias("filename"), "content")


def write_stream(done: DataFrame, target: str, checkpoint: str):
    """Starts a run over all that is there and not yet done, to Parquet."""
    return done.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def convert_stream(spark: SparkSession, source: str, target: str, checkpoint: str, registry: Registry | None = None):
    """Converts all files that are there and not yet done, to Parquet; run it again for those that came since."""
    return write_stream(converted(stream_files(spark, source), registry), target, checkpoint)


def convert_stream_to_files(spark: SparkSession, source: str, target: str, checkpoint: str, registry: Registry | None = None):
    """As `convert_stream`, to one Markdown file a document (see `sources.files.stream_markdown`)."""
    return stream_markdown(converted(stream_files(spark, source), registry), target, checkpoint)
