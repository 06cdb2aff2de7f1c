"""Sinks: result tables, session texts, manifests and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import b_suffix


def session_text(sessions: DataFrame, study: str, key: str, fields: list[str], valid: Column) -> DataFrame:
    """One JSON text per study: its volumes by sorted key, their fields by sorted name, indented by four; {} for invalid volumes.

    Where the sessions are dealt by study, no text moves.
    """
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("None")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [F.concat(F.lit(" " * 12), F.lit(f'"{f}": '), quote(F.col(f"`{f}`").cast("string"))) for f in sorted(fields)]
    body = F.when(valid, F.concat(F.lit("{\n"), F.array_join(F.array(*lines), ",\n"), F.lit("\n        }"))).otherwise(F.lit("{}"))
    entry = F.concat(F.lit(" " * 8), quote(F.col(key)), F.lit(": "), body)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), entry.alias("e")))), lambda s: s["e"]), ",\n")
    return sessions.groupBy(study).agg(text.alias("_t")).select(study, F.concat(F.lit("{\n    "), quote(F.col(study)), F.lit(": {\n"), F.col("_t"), F.lit("\n    }\n}")).alias("json"))


def write_sessions(texts: DataFrame, path: str) -> None:
    texts.select("json").write.text(path)


def write_results(results: DataFrame, path: str, order: list[str]) -> None:
    results.orderBy(*order).write.option("header", True).csv(path)


def write_sheet(sheet: DataFrame, path: str, kind: str = "parquet") -> None:
    sheet.write.mode("overwrite").option("header", True).format(kind).save(path)


def append_report(reports: DataFrame, path: str, column: str = "report") -> None:
    """Appends the texts that are not empty."""
    reports.select(column).where(F.length(column) > 0).write.mode("append").text(path)


def organized(vols: DataFrame, out: str) -> DataFrame:
    """The copy plan: each file of a volume to <out>/<series>_<volume>_<modality>[_b<value>]/<file>."""
    folder = F.concat(F.lit(out + "/"), F.format_string("%04d_%03d_%s", F.col("series_number"), F.col("volume_index"), F.col("series_modality")), b_suffix(F.col("b_value")))
    return vols.select("study_key", F.explode("files").alias("source"), folder.alias("_folder")).select("study_key", "source", F.concat("_folder", F.lit("/"), "source").alias("target"))
