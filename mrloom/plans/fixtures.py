"""Header tables derived from the given tables, in SQL that Spark and DuckDB both run.

inst: one row per file, from lineitem and orders; series_identifier is the key of B1 (UID, number, thickness, rows, columns), and the
geometry of most series is that of their study; the slices of a third each are apart along z, x and y, with or against their normal. tags: inst as maps of elements. voxels: the components of embeddings as voxels of small images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STUDY = "concat('1.2.', cast(o_custkey AS string)) AS study_key"
_NUMBER = "cast(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS int) AS series_number"
_JOINED = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
_FILES = f"""SELECT {_STUDY},
 concat('1.2.', cast(o_custkey AS string), '.', cast(o_orderkey AS string)) AS series_uid,
 {_NUMBER},
 concat_ws('-', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), cast(l_suppkey AS string), cast(cast(round(l_extendedprice * 100) AS bigint) AS string)) AS file_name,
 l_linenumber AS instance_number, cast(l_suppkey % 3 AS int) AS acquisition_number, l_shipdate AS acquisition_datetime,
 CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 5 = 1 THEN 0.0e0 WHEN l_orderkey % 5 = 2 THEN l_quantity * 25 WHEN l_orderkey % 5 = 3 THEN l_quantity + 5000 ELSE l_quantity END AS bvalue_raw,
 CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_partkey % 6 IN (1, 4) THEN 1.0e0 WHEN l_partkey % 6 = 5 THEN 1.0e0 ELSE 0.0e0 END AS gx,
 CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_partkey % 6 = 2 THEN 1.0e0 WHEN l_partkey % 6 = 3 THEN 0.6e0 WHEN l_partkey % 6 = 5 THEN 1.0e0 ELSE 0.0e0 END AS gy,
 CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_partkey % 6 = 3 THEN 0.8e0 ELSE 0.0e0 END AS gz,
 CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_tax * 1000 END AS echo_time, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice / 10 END AS repetition_time,
 CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice / 100 END AS pixel_bandwidth, l_discount * 900 AS flip_angle, cast(1 + g % 4 + CASE WHEN l_suppkey % 8 = 0 THEN 1 ELSE 0 END AS double) AS slice_thickness,
 1.0e0 + (g % 3) * 0.5e0 AS pixel_spacing_0, 1.0e0 + (g % 3) * 0.5e0 AS pixel_spacing_1,
 cast(128 * (1 + g % 2) AS int) AS n_rows, cast(128 * (1 + g % 2) AS int) AS n_columns,
 CASE g % 3 WHEN 0 THEN (1.0e0 - (g % 7) * 0.02e0) * (1 - g % 2 * 2) WHEN 1 THEN (g % 7) * 0.1e0 ELSE 1.0e0 - (g % 5) * 0.05e0 END AS iop_0,
 CASE WHEN g % 3 = 1 THEN 1.0e0 WHEN g % 5 = 0 THEN 0.1e0 ELSE 0.0e0 END AS iop_1, CASE WHEN g % 13 = 0 THEN 0.2e0 ELSE 0.0e0 END AS iop_2,
 CASE WHEN g % 3 = 0 AND g % 5 = 0 THEN -0.1e0 ELSE 0.0e0 END AS iop_3, CASE WHEN g % 3 = 0 THEN 1.0e0 ELSE (g % 2) * 0.1e0 END AS iop_4,
 CASE g % 3 WHEN 0 THEN (g % 9) * 0.0625e0 WHEN 1 THEN 1.0e0 - (g % 4) * 0.125e0 ELSE 1.0e0 - (g % 9) * 0.05e0 END AS iop_5,
 CASE WHEN g % 4 = 0 THEN -90.0e0 ELSE -100.5e0 END + CASE WHEN g % 3 = 1 THEN slice * 2.5e0 ELSE 0.0e0 END AS ipp_x,
 CASE WHEN l_orderkey % 11 = 0 THEN 5.0e0 ELSE 0.0e0 END + CASE WHEN g % 3 = 2 THEN slice * 2.5e0 ELSE 0.0e0 END AS ipp_y, CASE WHEN g % 3 = 0 THEN slice * 2.5e0 ELSE 40.0e0 END AS ipp_z,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('scan ', cast(o_orderkey % 5 AS string)) END AS series_description,
 CASE l_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'ORIGINAL/PRIMARY/M' WHEN 2 THEN 'DERIVED/PRIMARY/ADC' WHEN 3 THEN 'DERIVED/PRIMARY/EADC' WHEN 4 THEN 'DERIVED/PRIMARY/DIFFUSION/TRACEW' WHEN 5 THEN 'DERIVED/PRIMARY/DIFFUSION/FA' WHEN 6 THEN 'ORIGINAL/PRIMARY/PERFUSION' ELSE 'ORIGINAL/PRIMARY/DIFFUSION' END AS image_type,
 CASE l_suppkey % 5 WHEN 0 THEN 'SIEMENS' WHEN 1 THEN 'GE MEDICAL SYSTEMS' WHEN 2 THEN 'Philips' WHEN 3 THEN 'Hitachi' ELSE NULL END AS manufacturer,
 CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'None' WHEN 2 THEN '' WHEN 3 THEN 'no contrast' ELSE 'Gadavist' END AS contrast_agent,
 CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'SE' WHEN 2 THEN 'GR/IR' ELSE 'EP' END AS scanning_sequence, o_orderpriority AS label
FROM (SELECT *, CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey ELSE o_custkey END AS g, (l_linenumber - 1) % (1 + l_orderkey % 4) AS slice FROM {_JOINED}) AS files"""
INST = f"""SELECT *, concat_ws('.', series_uid, cast(series_number AS string), cast(cast(slice_thickness AS int) AS string), cast(n_rows AS string), cast(n_columns AS string)) AS series_identifier FROM ({_FILES}) AS inst_files"""

_TENTHS = "cast(cast(round({} * 10) AS bigint) AS string)"
#: Texts of header fields that inst holds, in SQL that both engines run; numbers as tenths.
FIELDS = {
    "StudyInstanceUID": "study_key",
    "SeriesInstanceUID": "series_uid",
    "SeriesNumber": "cast(series_number AS string)",
    "ImageOrientationPatient": "concat_ws('/', " + ", ".join(f"cast(cast(round(iop_{i} * 1000) AS bigint) AS string)" for i in range(6)) + ")",
    **{f: _TENTHS.format(c) for f, c in {"PixelBandwidth": "pixel_bandwidth", "EchoTime": "echo_time", "RepetitionTime": "repetition_time", "FlipAngle": "flip_angle", "SliceThickness": "slice_thickness"}.items()},
    "Manufacturer": "manufacturer",
    "ContrastBolusAgent": "contrast_agent",
    "ScanningSequence": "scanning_sequence",
    "SeriesDescription": "series_description",
}

#: A modality for each volume, so that the roll-up and repair can be held against SQL without a model.
GUESS = """CASE WHEN image_type LIKE '%EADC%' THEN 'eadc' WHEN image_type LIKE '%ADC%' THEN 'adc' WHEN image_type LIKE '%TRACEW%' THEN CASE WHEN series_number % 3 = 0 THEN 'LOW_PROBABILITY_tracew' ELSE 'tracew' END
 WHEN image_type LIKE '%/FA' THEN 'fa' WHEN image_type LIKE '%DIFFUSION%' THEN 'dwig' WHEN image_type LIKE '%PERFUSION%' THEN 't2w' WHEN volume_index % 2 = 1 THEN 't2w' WHEN series_number % 4 = 0 THEN 'pd' WHEN series_number % 5 = 1 THEN 'LOW_PROBABILITY_t1w' ELSE 'b0' END"""

VOXELS = """SELECT vec_id AS image, label AS series, 250.0e0 * (vec_id % 5) AS bvalue, cast(pos // 4 AS int) AS z, cast(pos // 2 % 2 AS int) AS y, cast(pos % 2 AS int) AS x, abs(cast(v AS double)) * 1000 AS v
 FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings)"""
THIN = VOXELS.replace("pos // 4", "pos // 16").replace("pos // 2 % 2", "pos // 4 % 4").replace("pos % 2 AS int) AS x", "pos % 4 AS int) AS x")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders that have files, with the number of their series: the rank of INST, taken on the orders before any file moves."""
    held = orders.join(lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    return held.withColumn("series_number", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("int"))


def inst(spark: SparkSession, sf_dir: str, numbered: bool = True, dealt: bool = False) -> DataFrame:
    """INST. Only columns of the tables move, the files' own are made afterwards, where they lie.

    numbered: else the series have no number and no identifier, and no rank is taken. dealt: the files are dealt by study_key and series_number.
    """
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    files = lineitem.join(_numbered(orders, lineitem) if numbered else orders.withColumn("series_number", F.lit(None).cast("int")), F.col("l_orderkey") == F.col("o_orderkey"))
    files = files.withColumn("study_key", F.concat(F.lit("1.2."), F.col("o_custkey").cast("string")))
    if dealt:
        files = files.repartition("study_key", "series_number")
    rows = spark.sql(INST.replace(_STUDY, "study_key").replace(_NUMBER, "series_number").replace(_JOINED, "{files}"), files=files)
    rows = rows.withColumn("acquisition_datetime", F.col("acquisition_datetime").cast("timestamp_ntz"))
    return rows if numbered else rows.drop("series_number", "series_identifier")


def inst_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INST as it stands. Its window keeps the filters that Spark makes from an explode of tagged() above it; below inst() these did not end."""
    rows = spark.sql(INST, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))
    return rows.withColumn("acquisition_datetime", F.col("acquisition_datetime").cast("timestamp_ntz"))


def inst_sql() -> str:
    return INST.format(lineitem="lineitem", orders="orders")


def voxels(spark: SparkSession, sf_dir: str, thin: bool = False) -> DataFrame:
    pos = F.col("pos")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    z, y, x = (F.floor(pos / 16), F.floor(pos / 4) % 4, pos % 4) if thin else (F.floor(pos / 4), F.floor(pos / 2) % 2, pos % 2)
    return rows.select(F.col("vec_id").alias("image"), F.col("label").alias("series"), (F.col("vec_id") % 5 * 250.0).alias("bvalue"), z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), (F.abs(F.col("v").cast("double")) * 1000).alias("v"))


#: Little-endian bytes of the components that the gradients of inst have.
_BYTES = {0.0: "0000000000000000", 0.6: "333333333333E33F", 0.8: "9A9999999999E93F", 1.0: "000000000000F03F"}


def with_packed_gradients(headers: DataFrame) -> DataFrame:
    """Headers of SIEMENS files with their gradient as 24 bytes under the maker's own tag. headers: tagged(), with manufacturer, gx, gy and gz."""
    packed = F.concat(*(F.coalesce(*(F.when(F.col(c) == v, b) for v, b in _BYTES.items())) for c in ("gx", "gy", "gz")))
    made = headers.withColumn("_packed", F.when((F.col("manufacturer") == "SIEMENS") & F.col("gx").isNotNull(), F.base64(F.unhex(packed))))
    element = F.create_map(F.lit("0019100E"), F.struct(F.lit("OB").alias("vr"), F.lit(None).cast("array<string>").alias("Value"), F.col("_packed").alias("InlineBinary")))
    rest = F.map_filter("tags", lambda k, _: k != "00189076")
    return made.select("file_name", F.when(F.col("_packed").isNull(), F.col("tags")).otherwise(F.map_concat(rest, element)).alias("tags"))


def tagged(files: DataFrame, *more: str) -> DataFrame:
    """inst as headers: file_name and the map of elements, b-values under the tag of the manufacturer. more: columns of the files that come along."""
    text = lambda c: F.col(c).cast("string")
    entry = lambda tag, vr, v, present: F.when(present, F.struct(F.lit(tag).alias("key"), F.struct(F.lit(vr).alias("vr"), v.alias("Value"), F.lit(None).cast("string").alias("InlineBinary")).alias("value")))
    one = lambda tag, vr, c: entry(tag, vr, F.array(text(c)), F.col(c).isNotNull())
    has_b = F.col("bvalue_raw").isNotNull()
    maker = F.coalesce("manufacturer", F.lit(""))
    b = F.col("bvalue_raw").cast("string")
    entries = [
        one("0020000D", "UI", "study_key"),
        one("0020000E", "UI", "series_uid"),
        one("00200011", "IS", "series_number"),
        one("00200013", "IS", "instance_number"),
        one("00180081", "DS", "echo_time"),
        one("00180080", "DS", "repetition_time"),
        one("00180095", "DS", "pixel_bandwidth"),
        one("00181314", "DS", "flip_angle"),
        one("00180050", "DS", "slice_thickness"),
        entry("00280030", "DS", F.array(text("pixel_spacing_0"), text("pixel_spacing_1")), F.lit(True)),
        entry("00200037", "DS", F.array(*(text(f"iop_{i}") for i in range(6))), F.lit(True)),
        one("00080070", "LO", "manufacturer"),
        one("00180010", "LO", "contrast_agent"),
        entry("00080008", "CS", F.split("image_type", "/"), F.col("image_type").isNotNull()),
        entry("00180020", "CS", F.split("scanning_sequence", "/"), F.col("scanning_sequence").isNotNull()),
        entry("0019100C", "IS", F.array(b), has_b & (maker == "SIEMENS")),
        entry("00431039", "IS", F.array((F.col("bvalue_raw") + 1000000000).cast("long").cast("string"), F.lit("8")), has_b & maker.startswith("GE")),
        entry("20011003", "FL", F.array(b), has_b & (maker == "Philips")),
        entry("00189087", "FD", F.array(b), has_b & ~maker.isin("SIEMENS", "GE MEDICAL SYSTEMS", "Philips")),
        entry("00189076", "FD", F.array(text("gx"), text("gy"), text("gz")), F.col("gx").isNotNull()),
    ]
    return files.select("file_name", *more, F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("tags"))
