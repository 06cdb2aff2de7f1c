"""New headers as a stream: files that arrive below a path are parsed and coded as they come.

Coding a header needs no other row, so the stream keeps no state but the list of files that it has
read; grouping into volumes and series needs all files of a series and runs as a batch over what this writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as C
from ..sources.headers import parse_headers


def watch(spark: SparkSession, path: str, files_at_once: int = 10_000) -> DataFrame:
    """A stream of (file_name, tags) of the JSON headers below a path; tags is null for what is no header."""
    texts = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).option("wholetext", True).text(path)
    return parse_headers(texts.select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("json")))


def coded(headers: DataFrame) -> DataFrame:
    """The diffusion features of each header."""
    tags = F.col("tags")
    b = C.b_value_of(tags)
    gradient = C.gradient_of(tags)
    return headers.where("tags IS NOT NULL").select("file_name", b.alias("b_value"), *(c.alias(n) for n, c in C.diffusion_flags(b, gradient.isNotNull()).items()))


def write_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what is there by now and ends; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
