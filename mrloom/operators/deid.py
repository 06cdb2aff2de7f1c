"""De-identification and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def new_uid(salt: str, *key: Column) -> Column:
    """A UID that depends on salt and key alone: the same key gets the same one everywhere, without a shuffle."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), *key), 256)
    # 31 hexadecimal digits, 124 bits: the number of a UID may have 39 digits, and a decimal holds 38.
    high, low = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(19,0)"), F.conv(F.substring(digest, 16, 16), 16, 10).cast("decimal(20,0)")
    return F.concat(F.lit("2.25."), (high * F.lit(str(1 << 64)).cast("decimal(20,0)") + low).cast("decimal(38,0)").cast("string"))


def remapped(files: DataFrame, salt: str, study: str, series: str, file: str) -> DataFrame:
    """New UIDs of study, series and file beside the old ones."""
    return files.withColumns({"new_study": new_uid(salt, F.col(study)), "new_series": new_uid(salt, F.col(study), F.col(series)), "new_instance": new_uid(salt, F.col(study), F.col(series), F.col(file))})


def is_private(tag: Column) -> Column:
    """Whether the group number of a tag is odd."""
    return F.conv(F.substring(tag, 4, 1), 16, 10).cast("int") % 2 == 1


def deidentified(headers: DataFrame, personal: list[str], dummy: str = "ANON") -> DataFrame:
    """Headers without private elements, but for the kept ones, and with a dummy for personal ones."""
    kept = F.map_filter("tags", lambda k, _: k.isin(S.KEPT_TAGS) | ~is_private(k))
    blank = F.array(F.lit(dummy))
    return headers.withColumn("tags", F.transform_values(kept, lambda k, e: F.when(k.isin(personal) & ~k.isin(S.KEPT_TAGS), F.struct(e["vr"].alias("vr"), blank.alias("Value"), F.lit(None).cast("string").alias("InlineBinary"))).otherwise(e)))


def bids_targets(files: DataFrame, path: str, study: str, date: str, series_number: str) -> DataFrame:
    """Target folder of each file: sub-<subject>/ses-<date>/<series>.

    The subject is the part before '_' of the folder three levels above the file. The session is the file's date, else the study's
    only date, else a number from the hash of the study; a file without date in a study of several has none and goes.
    """
    dates = F.array_sort(F.collect_set(date).over(Window.partitionBy(study)))
    made = (F.lit(30000000) + F.pmod(F.crc32(F.col(study)), F.lit(70000000))).cast("string")
    session = F.when(F.col(date).isNotNull(), F.col(date)).when(F.size("_dates") == 1, F.get("_dates", F.lit(0))).when(F.size("_dates") == 0, made)
    subject = F.split(F.element_at(F.split(path, "/"), -4), "_")[0]
    out = files.withColumn("_dates", dates).withColumn("_session", session).where("_session IS NOT NULL")
    return out.withColumn("target", F.concat(F.lit("sub-"), subject, F.lit("/ses-"), "_session", F.lit("/"), F.col(series_number).cast("string"))).drop("_dates", "_session")
