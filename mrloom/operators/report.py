"""Result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.fields import contrast_agent


def truth(c: Column) -> Column:
    return F.when(c, "True").when(~c, "False").otherwise("None")


def _shown() -> dict[str, Column]:
    return {
        "Isotropic": truth(F.col("isotropic")),
        "Bvalue": F.format_string("%.1f", "b_value"),
        "ImageType": F.when(F.col("volume_modality") == "INVALID", "Unknown").otherwise(F.coalesce("image_type", F.lit(S.TEXT_DEFAULTS["ImageType"]))),
        "SeriesDesc": F.coalesce("series_description", F.lit("UNKNOWN_SeriesDescription")),
    }


#: Fields of a session entry that stand there under names of their own.
_OWN = ("PixelSpacing", "ImageType")


def classification_table(results: DataFrame) -> DataFrame:
    """One row per volume, all text; order by the text columns gives the order of the reports ("10" before "2")."""
    shown = _shown()
    return results.select(
        "study_key",
        F.col("series_number").cast("string").alias("Series#"),
        F.col("volume_index").cast("string").alias("Vol.#"),
        F.col("volume_modality").alias("Volume Modality"),
        F.col("series_modality").alias("Series Modality"),
        F.col("plane").alias("Acq.Plane"),
        *(shown[c].alias(c) for c in ("Isotropic", "Bvalue", "SeriesDesc", "ImageType")),
    )


def session_dictionary(results: DataFrame, fields: dict[str, Column] | None = None) -> DataFrame:
    """The fields of each volume's entry in a session text, by key <series>_<volume>; null for invalid volumes, whose entry is empty.

    fields: texts of the header's required and optional fields, by name; those that are not given count as absent. Columns of class
    probabilities (GUESS_ONNX..., as score() makes them) come along if they are there.
    """
    shown, given = _shown(), fields or {}
    entry = {
        "VolumeModality": F.col("volume_modality"),
        "SeriesModality": F.col("series_modality"),
        "AcqPlane": F.col("plane"),
        **{c: shown[c] for c in ("Isotropic", "Bvalue", "ImageType")},
        "Contrast": F.when(F.col("contrast"), "True").otherwise("None"),
        "ContrastAgent": contrast_agent(F.col("agent"), F.col("contrast")),
        "PixelSpacing_0": F.col("pixel_spacing_0").cast("string"),
        "PixelSpacing_1": F.col("pixel_spacing_1").cast("string"),
        **{c: F.col(f"`{c}`").cast("string") for c in results.columns if c.startswith("GUESS_ONNX") and "CODE" not in c},
        **{f: F.coalesce(given.get(f, F.lit(None).cast("string")), F.lit(f"UNKNOWN_{f}")) for f in (*S.REQUIRED, *S.OPTIONAL) if f not in _OWN},
    }
    valid = F.col("volume_modality") != "INVALID"
    return results.select("study_key", F.concat_ws("_", F.col("series_number").cast("string"), F.col("volume_index").cast("string")).alias("key"), *(F.when(valid, c).alias(n) for n, c in entry.items()))
