"""Queries of sources, sinks, grouping, fields, classification and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import fields as C
from ..operators import classify, grouping, report
from ..sources import headers, sinks
from ..scratch import cleanup, scratch
from . import base as B
from . import fixtures
from .base import query


def _json(spark, sf_dir, *more):
    return fixtures.tagged(fixtures.inst(spark, sf_dir), *more).select("file_name", *more, F.to_json("tags").alias("json"))


_N_TAGS = "7 + (series_number IS NOT NULL)::int + " + " + ".join(f"({c} IS NOT NULL)::int" for c in ("echo_time", "repetition_time", "pixel_bandwidth", "manufacturer", "contrast_agent", "image_type", "scanning_sequence", "bvalue_raw", "gx"))


@query("a1_scan_headers", f"SELECT file_name, ({_N_TAGS})::int AS n_elements, series_number::varchar AS series_number, coalesce(manufacturer, '') AS manufacturer FROM inst", ("inst",))
def a1(spark, sf_dir):
    parsed = headers.parse_headers(_json(spark, sf_dir)).where("tags IS NOT NULL")
    return parsed.select("file_name", F.size("tags").alias("n_elements"), C.value(F.col("tags"), "00200011").alias("series_number"), F.coalesce(C.value(F.col("tags"), "00080070"), F.lit("")).alias("manufacturer"))


@query("a1_scan_files", "SELECT file_name, study_key AS StudyInstanceUID, series_number::varchar AS SeriesNumber, image_type AS ImageType, manufacturer AS Manufacturer FROM inst", ("inst",))
def a1_files(spark, sf_dir):
    """The headers, written as files of one header a line, and scanned. The files are packed: a header names the same elements as all others."""
    path = scratch(spark, "headers")
    own = F.create_map(F.lit(S.TAGS["SOPInstanceUID"]), F.struct(F.lit("UI").alias("vr"), F.array("file_name").alias("Value"), F.lit(None).cast("string").alias("InlineBinary")))
    with cleanup(spark):
        fixtures.tagged(fixtures.inst(spark, sf_dir)).select(F.to_json(F.map_concat("tags", own))).write.option("compression", "gzip").option("maxRecordsPerFile", 1_000_000).text(path)
    scanned = headers.scan_fields(spark, path, ["SOPInstanceUID", "StudyInstanceUID", "SeriesNumber", "ImageType", "Manufacturer", "ImageOrientationPatient", "EchoTime"], lines=True)
    return scanned.select(F.col("SOPInstanceUID").alias("file_name"), "StudyInstanceUID", "SeriesNumber", "ImageType", "Manufacturer")


@query("a2_project_header", "SELECT file_name, study_key AS StudyInstanceUID, series_number::varchar AS SeriesNumber, image_type AS ImageType, scanning_sequence AS ScanningSequence, contrast_agent AS ContrastBolusAgent, instance_number::varchar AS InstanceNumber FROM inst", ("inst",))
def a2(spark, sf_dir):
    parsed = headers.parse_headers(_json(spark, sf_dir))
    return headers.project(parsed, ["StudyInstanceUID", "SeriesNumber", "ImageType", "ScanningSequence", "ContrastBolusAgent", "InstanceNumber"])


@query("a3_get_field", "SELECT file_name, coalesce(manufacturer, 'UNKNOWN_Manufacturer') AS Manufacturer, 'UNKNOWN_SAR' AS SAR, study_key AS StudyInstanceUID FROM inst", ("inst",))
def a3(spark, sf_dir):
    tags = F.col("tags")
    return fixtures.tagged(fixtures.inst(spark, sf_dir)).select("file_name", *(C.field_or_unknown(tags, f).alias(f) for f in ("Manufacturer", "SAR", "StudyInstanceUID")))


@query("a4_union_sheets", "SELECT p_partkey AS \"key\", p_name AS name, p_size AS size, NULL::double AS balance FROM part UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def a4(spark, sf_dir):
    t = lambda n: fixtures.table(spark, sf_dir, n)
    return headers.union_sheets([t("part").selectExpr("p_partkey AS key", "p_name AS name", "p_size AS size"), t("supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")])


_SESSION_SQL = {"AcqPlane": "plane", "Bvalue": "printf('%.1f', b_value)", "Contrast": "CASE WHEN contrast THEN 'True' ELSE 'None' END", "ImageType": "coalesce(image_type, 'UnknownImageType')", "Isotropic": "CASE WHEN isotropic THEN 'True' WHEN NOT isotropic THEN 'False' ELSE 'None' END", "SeriesModality": "series_modality", "VolumeModality": "volume_modality"}
_SESSION_SQL |= {"ContrastAgent": "CASE WHEN contrast THEN agent ELSE 'None' END", "PixelSpacing_0": "printf('%.1f', pixel_spacing_0)", "PixelSpacing_1": "printf('%.1f', pixel_spacing_1)"}
_SESSION_SQL |= {f: f"coalesce({fixtures.FIELDS.get(f, 'NULL')}, 'UNKNOWN_{f}')" for f in (*S.REQUIRED, *S.OPTIONAL) if f not in ("PixelSpacing", "ImageType")}
_LINES = ", ".join(f"""repeat(' ', 12) || '"{k}": "' || {v} || '"'""" for k, v in sorted(_SESSION_SQL.items()))


#: What the session entries read of a volume, besides the roll-up's and repair's columns.
_SESSION_FROM = ["agent", "series_uid", "series_description", "pixel_bandwidth", "echo_time", "repetition_time", "flip_angle", "manufacturer", "contrast_agent", "scanning_sequence"]
_SCORES = ["GUESS_ONNX", *(f"GUESS_ONNX_{n}" for n in S.IMAGE_TYPES)]


def _sessions(spark, sf_dir, by_forest=False, by_study=False):
    results = B.results_by_forest(spark, sf_dir, _SESSION_FROM + _SCORES, by_study) if by_forest else B.results(spark, sf_dir, _SESSION_FROM, by_study=by_study)
    return report.session_dictionary(results, {f: F.expr(sql) for f, sql in fixtures.FIELDS.items()})


@query(
    "a5_write_session_json",
    f"""SELECT study_key, chr(123) || chr(10) || '    "' || study_key || '": ' || chr(123) || chr(10) || string_agg(e, ',' || chr(10) ORDER BY k) || chr(10) || '    ' || chr(125) || chr(10) || chr(125) AS json FROM (
SELECT study_key, k, repeat(' ', 8) || '"' || k || '": ' || CASE WHEN volume_modality = 'INVALID' THEN chr(123) || chr(125) ELSE chr(123) || chr(10) || concat_ws(',' || chr(10), {_LINES}) || chr(10) || '        ' || chr(125) END AS e
FROM (SELECT *, series_number || '_' || volume_index AS k FROM results)) GROUP BY study_key""",
    B.RESULTS,
)
def a5(spark, sf_dir):
    return sinks.session_text(_sessions(spark, sf_dir, by_study=True), "study_key", "key", list(_SESSION_SQL), F.col("VolumeModality").isNotNull())


@query("a5_write_session_json_model")
def a5_model(spark, sf_dir):
    """The session texts with the class probabilities of a stored forest."""
    sessions = _sessions(spark, sf_dir, by_forest=True, by_study=True)
    return sinks.session_text(sessions, "study_key", "key", sessions.columns[2:], F.col("VolumeModality").isNotNull())


_TABLE_SQL = """study_key, series_number::varchar AS "Series#", volume_index::varchar AS "Vol.#", volume_modality AS "Volume Modality", series_modality AS "Series Modality", plane AS "Acq.Plane", CASE WHEN isotropic THEN 'True' WHEN NOT isotropic THEN 'False' ELSE 'None' END AS Isotropic,
printf('%.1f', b_value) AS Bvalue, coalesce(series_description, 'UNKNOWN_SeriesDescription') AS "SeriesDesc", CASE WHEN is_valid THEN coalesce(image_type, 'UnknownImageType') ELSE 'Unknown' END AS ImageType"""


@query("a6_write_results_csv", f'SELECT concat_ws(\',\', study_key, "Series#", "Vol.#", "Volume Modality", "Series Modality", "Acq.Plane", Isotropic, Bvalue, "SeriesDesc", ImageType) AS line FROM (SELECT {_TABLE_SQL} FROM results) ORDER BY study_key, "Series#", "Vol.#"', B.RESULTS)
def a6(spark, sf_dir):
    rows = report.classification_table(B.results(spark, sf_dir, ["series_description"])).orderBy("study_key", "`Series#`", "`Vol.#`")
    return rows.select(F.concat_ws(",", *(f"`{c}`" for c in rows.columns)).alias("line"))


@query("a7_write_sheet", 'SELECT study_key, "Series#", count(*) AS n FROM (SELECT ' + _TABLE_SQL + ' FROM results) GROUP BY 1, 2', B.RESULTS)
def a7(spark, sf_dir):
    path = scratch(spark, "sheet")
    sinks.write_sheet(report.classification_table(B.results(spark, sf_dir, ["series_description"])), path)
    return spark.read.parquet(path).groupBy("study_key", "`Series#`").agg(F.count("*").alias("n"))


@query(
    "a8_organize_manifest",
    "SELECT study_key, f AS source, 'out/' || printf('%04d_%03d_', series_number, volume_index) || series_modality || CASE WHEN b_value >= 0 THEN '_b' || b_value::bigint ELSE '' END || '/' || f AS target FROM (SELECT *, unnest(files) AS f FROM results)",
    B.RESULTS,
)
def a8(spark, sf_dir):
    return sinks.organized(B.results(spark, sf_dir, ["files"]), "out")


@query("a9_empty_scan", "SELECT study_key, 'No headers in: ' || study_key AS message FROM (SELECT '1.2.' || c_custkey AS study_key FROM customer) WHERE study_key NOT IN (SELECT study_key FROM inst)", ("inst",))
def a9(spark, sf_dir):
    studies = fixtures.table(spark, sf_dir, "customer").select(F.concat(F.lit("1.2."), F.col("c_custkey").cast("string")).alias("study_key"))
    return headers.without_headers(studies, fixtures.inst(spark, sf_dir))


def _checked(spark, sf_dir):
    rules = [("not axial", F.col("plane") == "ax"), ("b-value missing", F.col("b_value") != S.MISSING), ("not isotropic", F.col("isotropic")), ("not axial", F.col("plane") == "ax")]
    vols = B.guessed(spark, sf_dir).withColumn("failures", classify.failures(rules))
    return vols.withColumn("report", classify.failure_report(F.col("failures")))


_REPORT_SQL = """SELECT study_key, series_number, volume_index, CASE WHEN len(f) = 0 THEN '' ELSE 'Identified image type: ' || volume_modality || '-' || plane || chr(10) || 'Identified bvalue: ' || b_value::bigint || chr(10) || 'Identified SeriesNumber: ' || series_number || chr(10) || chr(10) || 'Failure Messages:' || chr(10) || array_to_string(list_transform(f, lambda x: chr(9) || x), chr(10)) END AS report
FROM (SELECT *, list_filter([CASE WHEN plane <> 'ax' THEN 'not axial' END, CASE WHEN b_value = -12345 THEN 'b-value missing' END, CASE WHEN NOT isotropic THEN 'not isotropic' END], lambda x: x IS NOT NULL) AS f FROM guessed)"""


@query("a10_append_report", f"SELECT count(*) AS n_lines FROM (SELECT unnest(string_split(report, chr(10))) AS line FROM ({_REPORT_SQL}) WHERE report <> '')", B.GUESSED)
def a10(spark, sf_dir):
    path = scratch(spark, "log")
    sinks.append_report(_checked(spark, sf_dir), path)
    return spark.read.text(path).agg(F.count("*").alias("n_lines"))


# Grouping


@query("b1_series_identifier", "SELECT concat_ws('.', series_uid, series_number, slice_thickness::int, n_rows, n_columns) AS series_identifier, count(*) AS n, count(DISTINCT series_identifier) AS n_keys FROM inst GROUP BY 1", ("inst",))
def b1(spark, sf_dir):
    key = grouping.series_identifier(*(F.col(c) for c in ("series_uid", "series_number")), F.col("slice_thickness").cast("int"), F.col("n_rows"), F.col("n_columns"))
    return fixtures.inst(spark, sf_dir).withColumn("_key", key).groupBy(F.col("_key").alias("series_identifier")).agg(F.count("*").alias("n"), F.count_distinct("series_identifier").alias("n_keys"))


@query(
    "b2_parse_acq_datetime",
    """SELECT file_name, CASE WHEN d <> '' THEN coalesce(try_strptime(CASE WHEN length(d) = 14 THEN d END, '%Y%m%d%H%M%S'), TIMESTAMP '1900-01-01') ELSE coalesce(try_strptime(rpad(coalesce(a, '19000101'), 8, '0') || rpad(coalesce(t, '000000'), 6, '0'), '%Y%m%d%H%M%S'), TIMESTAMP '1900-01-01') END AS acquired FROM (
SELECT file_name, CASE instance_number % 4 WHEN 0 THEN strftime(acquisition_datetime, '%Y%m%d') || '101112' WHEN 1 THEN strftime(acquisition_datetime, '%Y%m%d%H%M%S') || '.5' WHEN 2 THEN '' END AS d,
CASE WHEN instance_number % 3 > 0 THEN strftime(acquisition_datetime, '%Y%m%d') END AS a, CASE WHEN acquisition_number > 0 THEN '1' || acquisition_number || '0130.25' END AS t FROM inst)""",
    ("inst",),
)
def b2(spark, sf_dir):
    day = F.date_format("acquisition_datetime", "yyyyMMdd")
    k = F.col("instance_number") % 4
    at = F.when(k == 0, F.concat(day, F.lit("101112"))).when(k == 1, F.concat(day, F.lit("000000.5"))).when(k == 2, F.lit(""))
    date = F.when(F.col("instance_number") % 3 > 0, day)
    time = F.when(F.col("acquisition_number") > 0, F.concat(F.lit("1"), F.col("acquisition_number").cast("string"), F.lit("0130.25")))
    return fixtures.inst(spark, sf_dir).select("file_name", C.acquisition_datetime(at, date, time).alias("acquired"))


@query("b3_sort_key", "SELECT file_name, row_number() OVER (PARTITION BY study_key, series_identifier ORDER BY acquisition_datetime, acquisition_number, instance_number, file_name)::int AS place FROM inst", ("inst",))
def b3(spark, sf_dir):
    return fixtures.inst(spark, sf_dir).select("file_name", F.row_number().over(Window.partitionBy(*grouping.KEY).orderBy(*grouping.file_order())).alias("place"))


@query(
    "b4_synthetic_position",
    """SELECT file_name, NOT given AS is_synthetic, CASE WHEN given THEN ipp_x ELSE 0 END AS ipp_x, CASE WHEN given THEN ipp_y ELSE 0 END AS ipp_y,
 CASE WHEN given THEN ipp_z ELSE coalesce(sum(is_new::int) OVER (PARTITION BY study_key, series_identifier ORDER BY file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double END AS ipp_z FROM fresh""",
    ("inst", "nulled"),
)
def b4(spark, sf_dir):
    files = fixtures.inst(spark, sf_dir).withColumns({c: F.when(F.col("acquisition_number") > 0, F.col(c)) for c in grouping.POSITION})
    return grouping.with_positions(files).select("file_name", "is_synthetic", *grouping.POSITION)


@query("b5_split_sub_volumes", "SELECT file_name, n_files, n_positions, n_volumes, sub_volume FROM split", ("inst", "split"))
def b5(spark, sf_dir):
    return B.split(spark, sf_dir).select("file_name", "n_files", "n_positions", "n_volumes", "sub_volume")


@query("b6_split_consistency", "SELECT DISTINCT series_identifier, is_even, n_files, n_positions FROM split", ("inst", "split"))
def b6(spark, sf_dir):
    return B.split(spark, sf_dir).select("series_identifier", "is_even", "n_files", "n_positions").distinct()


@query("b7_drop_unreadable", "SELECT study_key, count(*) AS n_files, sum((acquisition_number > 0)::int)::bigint AS n_readable FROM inst GROUP BY study_key", ("inst",))
def b7(spark, sf_dir):
    broken = _json(spark, sf_dir, "study_key", "acquisition_number").withColumn("json", F.when(F.col("acquisition_number") > 0, F.col("json")).otherwise(F.lit("{not a header")))
    return headers.parse_headers(broken).groupBy("study_key").agg(F.count("*").alias("n_files"), F.count("tags").alias("n_readable"))


@query("b8_reference_header", "SELECT study_key, series_identifier, sub_volume, file_name, array_to_string(files, ' ') AS files FROM vol", B.VOL)
def b8(spark, sf_dir):
    return grouping.volumes(B.split(spark, sf_dir)).select("study_key", "series_identifier", "sub_volume", "file_name", F.array_join("files", " ").alias("files"))


@query("b9_collect_series", "SELECT study_key, series_number, count(*) AS n_volumes, sum(len(files))::bigint AS n_files FROM vol GROUP BY 1, 2", B.VOL)
def b9(spark, sf_dir):
    return B.volumes(spark, sf_dir).groupBy("study_key", "series_number").agg(F.count("*").alias("n_volumes"), F.sum("n_slices").alias("n_files"))


@query("b10_volume_index", "SELECT study_key, series_number, series_identifier, sub_volume, volume_index FROM vol", B.VOL)
def b10(spark, sf_dir):
    return B.volumes(spark, sf_dir).select("study_key", "series_number", "series_identifier", "sub_volume", "volume_index")


@query("b11_search_series", "SELECT study_key, series_number, volume_index FROM vol WHERE series_number IN (1, 3)", B.VOL)
def b11(spark, sf_dir):
    return grouping.search_series(B.volumes(spark, sf_dir), [1, 3]).select("study_key", "series_number", "volume_index")


@query(
    "b12_series_info",
    """SELECT study_key, series_number, count(*)::int AS n_volumes, CASE WHEN count(*) > 1 THEN string_agg(DISTINCT b_value::varchar, ',' ORDER BY b_value::varchar) END AS b_values, (CASE WHEN count(*) = 1 THEN 1 ELSE count(DISTINCT b_value) END)::int AS n_b_values,
max(b_value) AS max_b_value, CASE WHEN count(*) > 1 THEN min(b_value) END AS min_b_value, arg_min(file_name, volume_index) AS first_file FROM (SELECT * REPLACE (b_value AS b_value) FROM coded) GROUP BY 1, 2""".replace(
        "string_agg(DISTINCT b_value::varchar, ',' ORDER BY b_value::varchar)", "array_to_string(list_transform(list_sort(list(DISTINCT b_value)), lambda v: printf('%.1f', v)), ',')"
    ),
    B.CODED,
)
def b12(spark, sf_dir):
    return grouping.series_info(B.volumes(spark, sf_dir))


@query("b13_series_size", "SELECT study_key, series_number, volume_index, printf('[%d, %d, %d]', n_rows, n_columns, len(files)) AS size FROM vol", B.VOL)
def b13(spark, sf_dir):
    return B.volumes(spark, sf_dir).select("study_key", "series_number", "volume_index", grouping.size_text(F.col("n_rows"), F.col("n_columns"), F.col("n_slices")).alias("size"))


_R = "CASE WHEN {0} IS NULL OR {0} = -12345 THEN '' ELSE printf('%.3f', {0}) END"
_PRIMARY_SQL = f"SELECT study_key, series_number::varchar AS SeriesNum, {_R.format('b_value')} AS Bval, {_R.format('repetition_time')} AS TR, {_R.format('echo_time')} AS TE, {_R.format('flip_angle')} AS FA, volume_index AS vol_index FROM coded"


@query("b14_primary_volume_info", _PRIMARY_SQL, B.CODED)
def b14(spark, sf_dir):
    return grouping.primary_info(B.volumes(spark, sf_dir))


@query(
    "b15_diagnostics_text",
    f"""SELECT study_key, SeriesNum, vol_index, repeat('=', 40) || chr(10) || chr(123) || '"Bval":"' || Bval || '","FA":"' || FA || '","SeriesNum":"' || SeriesNum || '","TE":"' || TE || '","TR":"' || TR || '","vol_index":' || vol_index || chr(125) || chr(10) || repeat('=', 40) AS diagnostics FROM ({_PRIMARY_SQL})""",
    B.CODED,
)
def b15(spark, sf_dir):
    return grouping.diagnostics(grouping.primary_info(B.volumes(spark, sf_dir)))


@query("b16_is_mr", "SELECT file_name FROM inst WHERE acquisition_number <> 1", ("inst",))
def b16(spark, sf_dir):
    files = fixtures.inst(spark, sf_dir).withColumn("modality", F.when(F.col("acquisition_number") == 1, "CT").otherwise("MR"))
    return grouping.magnetic_resonance(files).select("file_name")


# Fields

_ODD = "CASE instance_number % 6 WHEN 0 THEN ' 12 ' WHEN 1 THEN '1.0' WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN '-7' END"


def _odd(spark, sf_dir):
    return fixtures.inst(spark, sf_dir).withColumn("t", F.expr(_ODD))


@query("c1_is_number", f"SELECT file_name, coalesce(try_cast(trim(t) AS double) IS NOT NULL, false) AS is_number FROM (SELECT file_name, {_ODD} AS t FROM inst)", ("inst",))
def c1(spark, sf_dir):
    return _odd(spark, sf_dir).select("file_name", C.is_number(F.col("t")).alias("is_number"))


@query("c2_is_integer", rf"SELECT file_name, coalesce(regexp_full_match(t, '\s*[+-]?[0-9]+\s*'), false) AS is_integer FROM (SELECT file_name, {_ODD} AS t FROM inst)", ("inst",))
def c2(spark, sf_dir):
    return _odd(spark, sf_dir).select("file_name", C.is_integer(F.col("t")).alias("is_integer"))


@query("c3_numeric_or_sentinel", f"SELECT file_name, CASE WHEN try_cast(trim(t) AS double) IS NOT NULL THEN t ELSE '-12345' END AS v FROM (SELECT file_name, {_ODD} AS t FROM inst)", ("inst",))
def c3(spark, sf_dir):
    return _odd(spark, sf_dir).select("file_name", C.numeric_or_missing(F.col("t")).alias("v"))


@query(
    "c4_require_fields",
    """SELECT file_name, coalesce(CASE WHEN echo_time IS NULL THEN '-12345' ELSE printf('%.1f', echo_time) END) AS EchoTime, concat_ws(',', CASE WHEN pixel_bandwidth IS NULL THEN 'PixelBandwidth' END, CASE WHEN acquisition_number = 2 THEN 'SliceThickness' END) AS missing_fields, pixel_bandwidth IS NOT NULL AND acquisition_number <> 2 AS is_valid FROM inst""",
    ("inst",),
)
def c4(spark, sf_dir):
    files = fixtures.inst(spark, sf_dir)
    texts = {
        "StudyInstanceUID": F.col("study_key"),
        "SeriesInstanceUID": F.col("series_identifier"),
        "SeriesNumber": F.col("series_number").cast("string"),
        "ImageOrientationPatient": F.col("iop_0").cast("string"),
        "PixelBandwidth": F.col("pixel_bandwidth").cast("string"),
        "EchoTime": F.format_string("%.1f", "echo_time"),
        "RepetitionTime": F.col("repetition_time").cast("string"),
        "FlipAngle": F.col("flip_angle").cast("string"),
        "PixelSpacing": F.col("pixel_spacing_0").cast("string"),
        "SliceThickness": F.when(F.col("acquisition_number") == 2, "thick").otherwise(F.col("slice_thickness").cast("string")),
    }
    present = {f: F.lit(True) for f in texts} | {"EchoTime": F.col("echo_time").isNotNull(), "RepetitionTime": F.col("repetition_time").isNotNull(), "PixelBandwidth": F.col("pixel_bandwidth").isNotNull()}
    bad = F.filter(F.array(*(F.when(C.invalid(f, present[f], texts[f]), F.lit(f)) for f in S.REQUIRED)), lambda x: x.isNotNull())
    return files.select("file_name", C.required_value("EchoTime", present["EchoTime"], texts["EchoTime"]).alias("EchoTime"), F.array_join(bad, ",").alias("missing_fields"), (F.size(bad) == 0).alias("is_valid"))


@query(
    "c5_default_fields",
    """SELECT file_name, '-12345' AS SAR, coalesce(manufacturer, 'UnknownManufacturer') AS Manufacturer, coalesce(image_type, 'UnknownImageType') AS ImageType, coalesce(contrast_agent, '-12345') AS ContrastBolusAgent, coalesce(scanning_sequence, 'UnknownScanningSequence') AS ScanningSequence,
'UnknownSequenceVariant' AS SequenceVariant, 'UnknownInplanePhaseEncodingDirection' AS InPlanePhaseEncodingDirection, '000000.00' AS AcquisitionTime, 'UnknownSeriesDescription' AS SeriesDescription, CASE instance_number % 6 WHEN 0 THEN ' 12 ' WHEN 1 THEN '1.0' WHEN 4 THEN '-7' ELSE '-12345' END AS InversionTime FROM inst""",
    ("inst",),
)
def c5(spark, sf_dir):
    held = {"Manufacturer": "manufacturer", "ImageType": "image_type", "ContrastBolusAgent": "contrast_agent", "ScanningSequence": "scanning_sequence", "InversionTime": "t"}
    shown = ["SAR", "Manufacturer", "ImageType", "ContrastBolusAgent", "ScanningSequence", "SequenceVariant", "InPlanePhaseEncodingDirection", "AcquisitionTime", "SeriesDescription", "InversionTime"]
    text = lambda f: F.col(held[f]) if f in held else F.lit(None).cast("string")
    return _odd(spark, sf_dir).select("file_name", *(C.optional_value(f, text(f).isNotNull(), text(f)).alias(f) for f in shown))


#: Texts of the optional fields: columns of the headers, or texts that may be numbers.
_OPTIONAL = {
    "Manufacturer": "manufacturer", "ImageType": "image_type", "ContrastBolusAgent": "contrast_agent", "ScanningSequence": "scanning_sequence", "SeriesDescription": "series_description",
    "InversionTime": "t", "AcquisitionTime": "t", "EchoNumbers": "n", "NumberOfAverages": "contrast_agent", "MRAcquisitionType": "scanning_sequence", "VariableFlipAngleFlag": "contrast_agent", "SequenceVariant": "image_type",
}


def _optional_sql(field):
    c = _OPTIONAL.get(field, "NULL::varchar")
    number = f"CASE WHEN try_cast(trim({c}) AS double) IS NOT NULL THEN {c} ELSE '-12345' END"
    if field in S.NUMERIC or field == "ContrastBolusAgent":
        return f"coalesce({c if field == 'ContrastBolusAgent' else number}, '-12345')"
    return f"CASE WHEN {c} IS NULL THEN '000000.00' ELSE {number} END" if field == "AcquisitionTime" else f"coalesce({c}, '{S.TEXT_DEFAULTS[field]}')"


@query("c5_all_default_fields", "SELECT file_name, " + ", ".join(f'{_optional_sql(f)} AS "{f}"' for f in S.OPTIONAL) + f" FROM (SELECT *, {_ODD} AS t, instance_number::varchar AS n FROM inst)", ("inst",))
def c5_all(spark, sf_dir):
    files = _odd(spark, sf_dir).withColumn("n", F.col("instance_number").cast("string"))
    text = lambda f: F.col(_OPTIONAL[f]) if f in _OPTIONAL else F.lit(None).cast("string")
    return files.select("file_name", *(C.optional_value(f, text(f).isNotNull(), text(f)).alias(f) for f in S.OPTIONAL))


@query("c6_b_value", "SELECT file_name, (CASE WHEN bvalue_raw IS NULL OR bvalue_raw > 5000 THEN -12345 ELSE round_even(bvalue_raw / 10, 0) * 10 + 0.0 END)::double AS b_value FROM inst", ("inst",))
def c6(spark, sf_dir):
    return fixtures.tagged(fixtures.inst(spark, sf_dir)).select("file_name", C.b_value_of(F.col("tags")).alias("b_value"))


@query("c7_gradient_direction", "SELECT file_name, CASE WHEN gx IS NOT NULL AND abs(1 - sqrt(gx * gx + gy * gy + gz * gz)) <= 0.01 THEN printf('%.3f/%.3f/%.3f', gx, gy, gz) END AS gradient FROM inst", ("inst",))
def c7(spark, sf_dir):
    g = C.gradient_of(F.col("tags"), binary=True)
    return fixtures.with_packed_gradients(fixtures.tagged(fixtures.inst(spark, sf_dir), "manufacturer", "gx", "gy", "gz")).select("file_name", g.alias("g")).select("file_name", F.when(F.col("g").isNotNull(), F.format_string("%.3f/%.3f/%.3f", *(F.get("g", F.lit(i)) for i in range(3)))).alias("gradient"))


@query("c8_unit_norm", "SELECT file_name, coalesce(abs(1 - sqrt(gx * gx + gy * gy + gz * gz)) <= 0.01, false) AS is_unit FROM inst", ("inst",))
def c8(spark, sf_dir):
    return fixtures.inst(spark, sf_dir).select("file_name", C.unit_norm(F.array("gx", "gy", "gz")).alias("is_unit"))


@query("c9_index_expand", "SELECT file_name, abs(iop_0 - 0.5) AS ImageOrientationPatient_0, abs(iop_5) AS ImageOrientationPatient_1 FROM inst", ("inst",))
def c9(spark, sf_dir):
    return fixtures.inst(spark, sf_dir).select("file_name", *(c.alias(n) for n, c in C.index_columns("Image Orientation (Patient)".replace("(", "").replace(")", ""), F.array(F.col("iop_0") - 0.5, F.col("iop_5")), 2).items()))


@query("c10_array_min_max", "SELECT file_name, least(pixel_spacing_0, slice_thickness) AS PixelSpacingMin, greatest(pixel_spacing_0, slice_thickness) AS PixelSpacingMax FROM inst", ("inst",))
def c10(spark, sf_dir):
    return fixtures.inst(spark, sf_dir).select("file_name", *(c.alias(n) for n, c in C.min_max_columns("Pixel Spacing", F.array("pixel_spacing_0", "slice_thickness")).items()))


def _coded(name, columns):
    shown = ", ".join(f'"{c}"' for c in columns)

    @query(name, f"SELECT file_name, {shown} FROM coded", B.CODED)
    def run(spark, sf_dir):
        return B.volumes(spark, sf_dir).select("file_name", *(f"`{c}`" for c in columns))


_coded("c11_code_image_type", [f"ImageType_{p}" for p in ("ADC", "EADC", "DERIVED", "DIFFUSION", "FA", "ORIGINAL", "TRACEW", "PERFUSION")])
_coded("c12_code_manufacturer", ["Manufacturer_siemens"])
_coded("c13_code_scanning_sequence", ["ScanningSequence_GR", "ScanningSequence_IR", "ScanningSequence_SE"])
_coded("c15_code_contrast_agent", ["agent"])
_coded("c17_diffusion_features", ["b_value", "Diffusionb-valueBool", "has_b0", "has_pos_b0", "HasDiffusionGradientOrientation"])
_coded("c18_likely_diffusion", ["likely_diffusion"])
_coded("d2_acquisition_plane", ["plane"])
_coded("d3_is_isotropic", ["isotropic"])
_coded("d4_has_contrast", ["contrast"])


@query("c14_code_sequence_variant", "SELECT p_partkey, contains(lower(p_name), 'mp')::int AS SequenceVariant_MP, contains(lower(p_name), 'sp')::int AS SequenceVariant_SP FROM part")
def c14(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in C.sequence_codes("SequenceVariant", F.col("p_name")).items()))


@query("c16_text_rest", "SELECT file_name, " + ", ".join(f"CASE WHEN is_valid THEN {sql} END AS {f}" for f, sql in fixtures.FIELDS.items()) + ", is_valid FROM coded", B.CODED)
def c16(spark, sf_dir):
    rest = [F.when(F.col("is_valid"), F.expr(sql)).alias(f) for f, sql in fixtures.FIELDS.items()]
    return B.volumes(spark, sf_dir).select("file_name", *rest, "is_valid")


@query("c19_slugify", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[^\w\s-]', '', 'g'), '[-\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug FROM pages")
def c19(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "pages").select("page_id", C.slug(F.col("url")).alias("slug"))


@query("c20_b_suffix", "SELECT study_key, series_number, volume_index, CASE WHEN b_value >= 0 THEN '_b' || b_value::bigint ELSE '' END AS suffix, printf('%04d_%03d', series_number, volume_index) AS stem FROM coded", B.CODED)
def c20(spark, sf_dir):
    return B.volumes(spark, sf_dir).select("study_key", "series_number", "volume_index", C.b_suffix(F.col("b_value")).alias("suffix"), F.format_string("%04d_%03d", "series_number", "volume_index").alias("stem"))


# Classification


@query("d1_validate_features", f"SELECT file_name, CASE WHEN is_valid THEN '' ELSE '{','.join(S.FEATURES)}' END AS missing, plane, isotropic, contrast FROM coded", B.CODED)
def d1(spark, sf_dir):
    held = B.with_features(B.volumes(spark, sf_dir))
    return held.select("file_name", F.array_join(classify.missing_features(held), ",").alias("missing"), "plane", "isotropic", "contrast")


@query("d5_contrast_agent", "SELECT file_name, CASE WHEN contrast THEN agent ELSE 'None' END AS contrast_agent FROM coded", B.CODED)
def d5(spark, sf_dir):
    return B.volumes(spark, sf_dir).select("file_name", C.contrast_agent(F.col("agent"), F.col("contrast")).alias("contrast_agent"))


@query("d8_low_probability", "SELECT file_name, CASE WHEN greatest(gp, 1 - gp - 0.2) < 0.4 THEN 'LOW_PROBABILITY_' ELSE '' END || 't1w' AS name FROM (SELECT file_name, (instance_number % 7) / 10.0e0 AS gp FROM inst)", ("inst",))
def d8(spark, sf_dir):
    p = (F.col("instance_number") % 7) / 10.0
    return fixtures.inst(spark, sf_dir).select("file_name", C.with_low_probability(F.lit("t1w"), F.array(p, 1 - p - 0.2)).alias("name"))


@query("d9_infer_diffusion_from_gradient", "SELECT study_key, series_number, by_gradient FROM g", B.ROLLED)
def d9(spark, sf_dir):
    vols = B.guessed(spark, sf_dir)
    return vols.groupBy("study_key", "series_number").agg(classify.by_gradient(F.min_by(F.col("image_type").isNotNull(), "volume_index"), F.count_distinct("gradient")).alias("by_gradient"))


@query("d10_rollup_single", "SELECT study_key, series_number, series_modality, plane, isotropic, contrast FROM rolled WHERE n = 1", B.ROLLED)
def d10(spark, sf_dir):
    return B.rolled(spark, sf_dir).where("n = 1").select("study_key", "series_number", "series_modality", "plane", "isotropic", "contrast")


@query("d11_rollup_multi", "SELECT study_key, series_number, n, series_modality, plane, isotropic, contrast FROM rolled WHERE n > 1", B.ROLLED)
def d11(spark, sf_dir):
    return B.rolled(spark, sf_dir).where("n > 1").select("study_key", "series_number", "n", "series_modality", "plane", "isotropic", "contrast")


@query("d12_perfusion_override", "SELECT study_key, series_number FROM rolled WHERE series_modality = 'perfusion'", B.ROLLED)
def d12(spark, sf_dir):
    return B.rolled(spark, sf_dir).where("series_modality = 'perfusion'").select("study_key", "series_number")


@query("d13_same_physical_space", "SELECT a.study_key, a.series_number, a.space = b.space AS same FROM p a JOIN p b ON a.study_key = b.study_key AND b.series_number = a.series_number + 1", B.REPAIRED)
def d13(spark, sf_dir):
    series = B.placed(spark, sf_dir)
    a, b = series.alias("a"), series.withColumn("_before", F.col("series_number") - 1).alias("b")
    return a.join(b, (F.col("a.study_key") == F.col("b.study_key")) & (F.col("a.series_number") == F.col("b._before"))).select("a.study_key", "a.series_number", classify.same_space("a", "b", B.SPACE).alias("same"))


@query("d14_fixup_adjacent_series", "SELECT study_key, series_number, series_modality, is_repaired FROM repaired", B.REPAIRED)
def d14(spark, sf_dir):
    return B.repaired(spark, sf_dir).select("study_key", "series_number", "series_modality", "is_repaired")


@query("d15_run_inference", "SELECT study_key, series_number, volume_index, volume_modality, series_modality FROM results", B.RESULTS)
def d15(spark, sf_dir):
    return B.results(spark, sf_dir, []).select("study_key", "series_number", "volume_index", "volume_modality", "series_modality")


@query("d15_run_inference_model")
def d15_model(spark, sf_dir):
    """The whole chain with the modality of every valid volume from a stored forest."""
    return B.results_by_forest(spark, sf_dir, ["GUESS_ONNX"]).select("study_key", "series_number", "volume_index", "GUESS_ONNX", "volume_modality", "series_modality")


@query("d16_select_sequences", "SELECT study_key, series_number, volume_index FROM guessed WHERE volume_modality = 'b0' AND plane = 'ax'", B.GUESSED)
def d16(spark, sf_dir):
    return classify.select_sequences(B.guessed(spark, sf_dir), "b0", "ax").select("study_key", "series_number", "volume_index")


@query(
    "d17_run_numbering",
    "SELECT study_key, series_number, volume_index, study_key || '_ses-' || instance_number % 2 || '_run-00' || row_number() OVER (PARTITION BY study_key, instance_number % 2, plane, volume_modality ORDER BY series_number, volume_index) || '_acq-' || plane || '_desc-spark_' || volume_modality AS name FROM guessed",
    B.GUESSED,
)
def d17(spark, sf_dir):
    vols = B.guessed(spark, sf_dir).withColumn("ses", F.concat(F.lit("ses-"), (F.col("instance_number") % 2).cast("string")))
    return classify.run_names(vols, "study_key", "ses", "spark").select("study_key", "series_number", "volume_index", "name")


@query("d18_custom_classifier", "SELECT file_name, CASE WHEN ImageType_TRACEW = 1 THEN 'tracew' WHEN b_value = 0 THEN 'b0' WHEN HasDiffusionGradientOrientation = 1 THEN 'dwig' ELSE 'other' END AS volume_modality FROM coded", B.CODED)
def d18(spark, sf_dir):
    rules = [("tracew", F.col("ImageType_TRACEW") == 1), ("b0", F.col("b_value") == 0), ("dwig", F.col("HasDiffusionGradientOrientation") == 1)]
    return classify.by_rules(B.volumes(spark, sf_dir), rules, "other").select("file_name", "volume_modality")


@query("d19_validation_rules", _REPORT_SQL, B.GUESSED)
def d19(spark, sf_dir):
    return _checked(spark, sf_dir).select("study_key", "series_number", "volume_index", "report")


# Reports


@query("e1_classification_table", f"SELECT {_TABLE_SQL} FROM results", B.RESULTS)
def e1(spark, sf_dir):
    return report.classification_table(B.results(spark, sf_dir, ["series_description"]))


@query("e2_session_dictionary", "SELECT study_key, series_number || '_' || volume_index AS \"key\", " + ", ".join(f'CASE WHEN is_valid THEN {v} END AS "{k}"' for k, v in _SESSION_SQL.items()) + " FROM results", B.RESULTS)
def e2(spark, sf_dir):
    return _sessions(spark, sf_dir)


@query("e2_session_dictionary_model")
def e2_model(spark, sf_dir):
    """The session entries with the class probabilities of a stored forest."""
    return _sessions(spark, sf_dir, by_forest=True)


@query("e3_multi_study", 'SELECT study_key AS "StudyPathName", count(*) AS n_volumes, count(DISTINCT series_number) AS n_series, sum((series_modality = \'tracew\')::int)::bigint AS n_tracew FROM results GROUP BY 1', B.RESULTS)
def e3(spark, sf_dir):
    return B.results(spark, sf_dir, []).groupBy(F.col("study_key").alias("StudyPathName")).agg(F.count("*").alias("n_volumes"), F.count_distinct("series_number").alias("n_series"), F.sum((F.col("series_modality") == "tracew").cast("int")).alias("n_tracew"))


@query("flagship", "SELECT plane, b_value, likely_diffusion, count(*) AS n FROM coded GROUP BY ALL", B.CODED)
def flagship(spark, sf_dir):
    return B.volumes(spark, sf_dir).groupBy("plane", "b_value", "likely_diffusion").agg(F.count("*").alias("n"))
