"""From files to volumes and series.

Input tables have one row per file; series_identifier is the key that series_identifier() makes. split_volumes() deals the files
by (study_key, series_number), and all windows and groupings up to the series are keyed by these two or more, so this one
exchange serves them all, and a filter on series numbers goes below them. Ties end in file_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S

SERIES = ["study_key", "series_number"]
KEY = [*SERIES, "series_identifier"]
#: The place of a file's first pixel, and the directions of its rows and columns.
POSITION = ["ipp_x", "ipp_y", "ipp_z"]
DIRECTION = [f"iop_{i}" for i in range(6)]


def series_identifier(series_uid: Column, *details: Column) -> Column:
    """Series UID with the details that part its files: number, sequence name, thickness, rows, columns."""
    return F.concat_ws(".", series_uid, *(d.cast("string") for d in details))


def file_order() -> list[Column]:
    """Order of files at one position."""
    missing = F.lit(S.MISSING)
    return [F.coalesce("acquisition_datetime", F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")), F.coalesce("acquisition_number", missing), F.coalesce("instance_number", missing), F.col("file_name")]


def slice_place(position: list[str] | None = None, direction: list[str] | None = None) -> Column:
    """Place along the slice normal: the position's product with the cross product of the row and column directions."""
    x, y, z = map(F.col, position or POSITION)
    r0, r1, r2, c0, c1, c2 = map(F.col, direction or DIRECTION)
    return x * (r1 * c2 - r2 * c1) + y * (r2 * c0 - r0 * c2) + z * (r0 * c1 - r1 * c0)


def with_positions(files: DataFrame, position: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Files without a whole position get (0, 0, n), n being the positions so far in the order of the files; strict: they raise.

    A position that is made equals a given one of the same numbers.
    """
    position = position or POSITION
    gone = F.lit(False)
    for c in position:
        gone = gone | F.col(c).isNull()
    if strict:
        return files.withColumns({c: F.when(gone, F.raise_error(F.concat(F.lit("no position: "), F.col("file_name")))).otherwise(F.col(c)) for c in position})
    new = gone | (F.row_number().over(Window.partitionBy(*KEY, *position).orderBy("file_name")) == 1)
    before = Window.partitionBy(*KEY).orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)
    marked = files.withColumns({"is_synthetic": gone, "_new": new.cast("int")})
    made = [F.lit(0.0), F.lit(0.0), F.coalesce(F.sum("_new").over(before), F.lit(0)).cast("double")]
    return marked.withColumns({c: F.when(F.col("is_synthetic"), m).otherwise(F.col(c)) for c, m in zip(position, made, strict=True)}).drop("_new")


def split_volumes(files: DataFrame, position: list[str] | None = None, strict: bool = False) -> DataFrame:
    """files with n_files, n_positions, n_volumes and sub_volume (null: a surplus file that no volume takes).

    Positions are whole ones (all coordinates). With fewer positions than files, volume i takes the i-th file of every position. If a position
    has too few files for that, the whole series is one volume. strict: surplus files raise.
    """
    at = Window.partitionBy(*KEY, *(position or POSITION))
    whole = Window.partitionBy(*KEY)
    ranked = files.repartition(*SERIES).withColumns({"_rank": F.row_number().over(at.orderBy(*file_order())), "_here": F.count("*").over(at)})
    counted = ranked.withColumns({"n_files": F.count("*").over(whole).cast("int"), "n_positions": F.sum((F.col("_rank") == 1).cast("int")).over(whole).cast("int"), "_least": F.min("_here").over(whole)})
    per = (F.col("n_files") / F.col("n_positions")).cast("int")
    multi = (F.col("n_positions") < F.col("n_files")) & (F.col("_least") >= per)
    out = counted.withColumns(
        {
            "is_even": F.col("n_files") % F.col("n_positions") == 0,
            "n_volumes": F.when(multi, per).otherwise(1),
            "sub_volume": F.when(~multi, 0).when(F.col("_rank") <= per, (F.col("_rank") - 1).cast("int")),
        }
    ).drop("_rank", "_here", "_least")
    if strict:
        out = out.withColumn("sub_volume", F.when(~F.col("is_even"), F.raise_error(F.concat(F.lit("uneven series: "), F.col("series_identifier")))).otherwise(F.col("sub_volume")))
    return out


def _taken(split: DataFrame) -> DataFrame:
    return split.where("sub_volume IS NOT NULL AND series_number IS NOT NULL")


def _indexed(vols: DataFrame) -> DataFrame:
    index = F.row_number().over(Window.partitionBy(*SERIES).orderBy("series_identifier", "sub_volume")) - 1
    return vols.withColumn("volume_index", index.cast("int"))


def volumes(split: DataFrame, order: Column | None = None) -> DataFrame:
    """volume_headers() with the files of each volume, in slice order, by one aggregation that finds the exchange of the split in place."""
    own = [c for c in split.columns if c not in (*KEY, "sub_volume", "_order")]
    placed = _taken(split).withColumn("_order", F.struct((slice_place() if order is None else order).alias("place"), F.col("file_name").alias("file")))
    agg = placed.groupBy(*KEY, "sub_volume").agg(F.min_by(F.struct(*own), "_order").alias("_first"), F.array_sort(F.collect_list("_order"))["file"].alias("files"))
    return _indexed(agg.select(*KEY, "sub_volume", *(f"_first.{c}" for c in own), "files", F.size("files").alias("n_slices"))).select(*split.columns, "n_slices", "files", "volume_index")


def volume_headers(split: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per volume: the columns of its first file in slice order, n_slices (its number of files), and volume_index in its series.

    order: place along the slice normal, ties by file name; default slice_place(). Columns that are not asked for are never read.
    """
    volume = Window.partitionBy(*KEY, "sub_volume")
    first = volume.orderBy(slice_place() if order is None else order, "file_name")
    return _indexed(_taken(split).withColumns({"_place": F.row_number().over(first), "n_slices": F.count("*").over(volume).cast("int")}).where("_place = 1").drop("_place"))


def quarantine(files: DataFrame) -> DataFrame:
    """Files that no series takes, with the reason."""
    return files.where("series_number IS NULL").select("study_key", "file_name", F.lit("no SeriesNumber").alias("reason"))


def search_series(table: DataFrame, numbers: list[int]) -> DataFrame:
    """Only the requested series. series_number is in the key of every window and grouping, so the optimizer pushes the filter below them."""
    return table.where(F.col("series_number").isin(numbers))


def series_info(vols: DataFrame) -> DataFrame:
    """b-values of each series, and the first volume's description of it."""
    single = F.count("*") == 1
    return vols.groupBy("study_key", "series_number").agg(
        F.count("*").cast("int").alias("n_volumes"),
        F.when(single, F.lit(None)).otherwise(F.array_join(F.array_sort(F.collect_set("b_value")), ",")).alias("b_values"),
        F.when(single, F.lit(1)).otherwise(F.count_distinct("b_value")).cast("int").alias("n_b_values"),
        F.max("b_value").alias("max_b_value"),
        F.when(single, F.lit(None)).otherwise(F.min("b_value")).alias("min_b_value"),
        F.min_by("file_name", "volume_index").alias("first_file"),
    )


def size_text(rows: Column, columns: Column, slices: Column) -> Column:
    return F.format_string("[%d, %d, %d]", F.coalesce(rows, F.lit(0)), F.coalesce(columns, F.lit(0)), slices)


def report_number(c: Column) -> Column:
    """A number for reports: three decimals, nothing for the sentinel or null."""
    return F.when(c.isNull() | (c == S.MISSING), F.lit("")).otherwise(F.format_string("%.3f", c.cast("double")))


def primary_info(vols: DataFrame) -> DataFrame:
    return vols.select(
        "study_key",
        F.col("series_number").cast("string").alias("SeriesNum"),
        report_number(F.col("b_value")).alias("Bval"),
        report_number(F.col("repetition_time")).alias("TR"),
        report_number(F.col("echo_time")).alias("TE"),
        report_number(F.col("flip_angle")).alias("FA"),
        F.col("volume_index").alias("vol_index"),
    )


def diagnostics(info: DataFrame) -> DataFrame:
    """The primary info as one text between rulers, its fields sorted by name."""
    body = F.to_json(F.struct(*sorted(c for c in info.columns if c != "study_key")))
    return info.select("study_key", "SeriesNum", "vol_index", F.concat(F.lit("=" * 40 + "\n"), body, F.lit("\n" + "=" * 40)).alias("diagnostics"))


def magnetic_resonance(table: DataFrame) -> DataFrame:
    """Rows of MR modality."""
    return table.where(F.col("modality") == "MR")
