"""Sources: headers in the JSON model, and sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import fields as C

FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "orc": "orc"}


def scan_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all JSON files below a path: file_name and the map of elements. A file that is no header is left out
    here and found by unreadable_headers."""
    return parse_headers(_texts(spark, path)).where("tags IS NOT NULL")


def scan_fields(spark: SparkSession, path: str, names: list[str], lines: bool = False) -> DataFrame:
    """Named fields of all JSON files below a path, as project() gives them, with the file's path.

    Only the elements of these fields stand in the read schema, so that the parser skips all others (pixels, bulk data, private elements), and of
    these only the ones that the query asks for are built. Files that are no header are left out. A file holds one header, or one on each line
    (lines), which can be split.
    """
    fields = T.StructType([T.StructField(S.TAGS[n], T.StructType([T.StructField("Value", T.ArrayType(T.StringType()))])) for n in names])
    rows = spark.read.schema(fields).option("recursiveFileLookup", True).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), *(F.array_join(F.col(f"`{S.TAGS[n]}`.Value"), "/").alias(n) for n in names))


def unreadable_headers(spark: SparkSession, path: str) -> DataFrame:
    return parse_headers(_texts(spark, path)).where("tags IS NULL").select("file_name", F.lit("unreadable").alias("reason"))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("json"))


def parse_headers(rows: DataFrame, json: str = "json") -> DataFrame:
    """file_name and tags; tags is null where the text does not parse to elements."""
    # Parsed once: what stands above a generator is not merged into what stands below.
    parsed = rows.select("*", F.explode(F.array(F.from_json(json, C.TAG_MAP))).alias("_tags"))
    return parsed.withColumn("tags", F.when(F.size(F.map_keys("_tags")) > 0, F.col("_tags"))).drop(json, "_tags")


def project(headers: DataFrame, names: list[str]) -> DataFrame:
    """Named fields as columns: the values of a field joined by '/', null where absent."""
    return headers.select("file_name", *(F.array_join(C.element(F.col("tags"), S.TAGS[n])["Value"], "/").alias(n) for n in names))


def union_sheets(sheets: list[DataFrame]) -> DataFrame:
    """Sheets stacked; a column that a sheet lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def read_sheets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sheets by path, stacked. Temporary files (~$...) are skipped; an unknown kind is an error."""
    out = []
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if name.startswith("~$"):
            continue
        kind = name.rsplit(".", 1)[-1].lower()
        if kind not in FORMATS:
            raise ValueError(f"unknown kind of sheet: {path}")
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        out.append(reader.format(FORMATS[kind]).load(path))
    if not out:
        raise ValueError("no sheet to read")
    return union_sheets(out)


def without_headers(studies: DataFrame, headers: DataFrame, key: str = "study_key", strict: bool = False) -> DataFrame:
    """Requested studies of which no header was found; strict: they raise."""
    gone = studies.join(headers.select(key).distinct(), key, "left_anti")
    message: Column = F.concat(F.lit("No headers in: "), F.col(key))
    return gone.select(key, (F.raise_error(message).cast("string") if strict else message).alias("message"))
