"""Queries of sheets, training, voxels and de-identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.fields import value
from ..operators import classify, deid, forests, grouping, sheet, training, voxels
from ..scratch import stored
from . import base as B
from . import fixtures
from .base import query
from .fixtures import table

_NAMES = {"00080070": "Manufacturer", "00180081": "Echo Time", "00180020": "Scanning Sequence", "00080008": "Image Type", "00200011": "Series Number", "0020000D": "Study Instance UID", "00181314": "Flip Angle"}


def _fields(spark, sf_dir):
    return sheet.to_fields(fixtures.tagged(fixtures.inst_by_sql(spark, sf_dir)), _NAMES)


_FIELDS_SQL = """SELECT file_name, 'Manufacturer' AS name, manufacturer AS value FROM inst WHERE manufacturer IS NOT NULL UNION ALL SELECT file_name, 'Scanning Sequence', scanning_sequence FROM inst WHERE scanning_sequence IS NOT NULL
UNION ALL SELECT file_name, 'Image Type', image_type FROM inst WHERE image_type IS NOT NULL UNION ALL SELECT file_name, 'Echo Time', printf('%.3f', echo_time) FROM inst WHERE echo_time IS NOT NULL UNION ALL SELECT file_name, 'Flip Angle', printf('%.3f', flip_angle) FROM inst"""


@query("f1_header_to_fields", f"SELECT * FROM ({_FIELDS_SQL})", ("inst",))
def f1(spark, sf_dir):
    # Numbers in three decimals, as the engines write doubles in different ways.
    rows = _fields(spark, sf_dir)
    return rows.withColumn("value", F.when(F.col("name").isin("Echo Time", "Flip Angle"), F.format_string("%.3f", F.col("value").cast("double"))).otherwise(F.col("value")))


_MORE_NAMES = {"00180080": "Repetition Time", "00180095": "Pixel Bandwidth", "00180050": "Slice Thickness", "00280030": "Pixel Spacing", "00180010": "Contrast/Bolus Agent", "00200013": "Instance Number", "00200037": "Image Orientation (Patient)", "00189087": "Diffusion b-value", "00189076": "Diffusion Gradient Orientation"}
#: Numbers of a field, by columns; and which files have it.
_NUMBERS = {
    "Echo Time": ["echo_time"], "Flip Angle": ["flip_angle"], "Repetition Time": ["repetition_time"], "Pixel Bandwidth": ["pixel_bandwidth"], "Slice Thickness": ["slice_thickness"], "Pixel Spacing": ["pixel_spacing_0", "pixel_spacing_1"],
    "Image Orientation (Patient)": [f"iop_{i}" for i in range(6)], "Diffusion b-value": ["bvalue_raw"], "Diffusion Gradient Orientation": ["gx", "gy", "gz"],
}
_HAS = {"Diffusion b-value": " AND coalesce(manufacturer, '') NOT IN ('SIEMENS', 'GE MEDICAL SYSTEMS', 'Philips')"}
_ALL_FIELDS_SQL = " UNION ALL ".join(
    [f"SELECT file_name, '{n}' AS name, {c} AS value FROM inst WHERE {c} IS NOT NULL" for n, c in {"Manufacturer": "manufacturer", "Scanning Sequence": "scanning_sequence", "Image Type": "image_type", "Contrast/Bolus Agent": "contrast_agent"}.items()]
    + ["SELECT file_name, '" + n + "', " + " || '/' || ".join(f"cast(cast(round({c} * 1000) AS bigint) AS varchar)" for c in columns) + f" FROM inst WHERE {columns[0]} IS NOT NULL" + _HAS.get(n, "") for n, columns in _NUMBERS.items()]
)


@query("f1_all_header_fields", _ALL_FIELDS_SQL, ("inst",))
def f1_all(spark, sf_dir):
    """Every element of the headers that a sheet holds; numbers in thousandths."""
    rows = sheet.to_fields(fixtures.tagged(fixtures.inst_by_sql(spark, sf_dir)), {**_NAMES, **_MORE_NAMES})
    numbers = F.array_join(F.transform(F.split("value", "/"), lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), "/")
    return rows.withColumn("value", F.when(F.col("name").isin(list(_NUMBERS)), numbers).otherwise(F.col("value")))


@query("f2_field_sheet", "SELECT file_name, image_type AS \"Image Type\", coalesce(manufacturer, 'none') AS \"Manufacturer\", scanning_sequence AS \"Scanning Sequence\", instance_number FROM inst", ("inst",))
def f2(spark, sf_dir):
    coded = fixtures.inst(spark, sf_dir).select("file_name", F.coalesce("manufacturer", F.lit("none")).alias("Manufacturer"), "instance_number")
    return sheet.field_sheet(_fields(spark, sf_dir), ["Image Type", "Manufacturer", "Scanning Sequence"], coded)


@query("f3_ordered_columns", "SELECT * FROM (VALUES (0, 'FileName'), (1, 'ImageType'), (2, 'SeriesNumber'), (3, 'SliceThickness'), (4, 'p_name'), (5, 'p_size')) t(place, name), (SELECT count(*) AS n_rows FROM part)")
def f3(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("SeriesNumber"), "p_size", F.col("p_type").alias("ImageType"), F.col("p_retailprice").alias("SliceThickness"), F.col("p_brand").alias("FileName"))
    names = sheet.ordered_columns([*rows.columns, "p_name"])
    ordered = rows.select(*names).agg(F.count("*").alias("n_rows"))
    return ordered.select(F.posexplode(F.array(*map(F.lit, names))).alias("place", "name"), "n_rows")


@query("f3_ordered_sheet", "SELECT p_brand AS \"FileName\", p_type AS \"ImageType\", p_partkey AS \"SeriesNumber\", p_retailprice AS \"SliceThickness\", p_name, p_size, 'FileName,ImageType,SeriesNumber,SliceThickness,p_name,p_size' AS columns FROM part")
def f3_sheet(spark, sf_dir):
    """The sheet itself, its columns in order; columns: their names, as they stand."""
    rows = table(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("SeriesNumber"), "p_size", F.col("p_type").alias("ImageType"), F.col("p_retailprice").alias("SliceThickness"), F.col("p_brand").alias("FileName"))
    ordered = rows.select(*sheet.ordered_columns(rows.columns))
    return ordered.withColumn("columns", F.lit(",".join(ordered.columns)))


@query("f4_drop_unnamed", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name END AS FileName FROM part WHERE p_size % 3 > 0")
def f4(spark, sf_dir):
    return sheet.named_rows(table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("FileName")))


def _sheet(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    maker = F.when(F.col("p_partkey") % 4 == 0, "SIEMENS").when(F.col("p_partkey") % 4 == 1, "GE Medical").when(F.col("p_partkey") % 4 == 2, "Acme")
    return parts.select(F.col("p_partkey").alias("FileName"), F.translate("p_name", " ", "_").alias("Image Type"), maker.alias("Manufacturer"), F.col("p_type").alias("MR Acquisition Type"), F.col("p_size").alias("A very long name of a sheet's column"))


_MAKER = "CASE p_partkey % 4 WHEN 0 THEN 'SIEMENS' WHEN 1 THEN 'GE Medical' WHEN 2 THEN 'Acme' END"


@query("f5_config_projection", "SELECT p_partkey AS FileName, p_size AS \"" + "A very long name of a sheet's column"[:34] + f"\", (p_partkey % 4 = 0)::int AS Manufacturer_siemens, (p_partkey % 4 = 1)::int AS Manufacturer_ge, 0 AS Manufacturer_philips, 0 AS Manufacturer_toshiba, (p_partkey % 4 = 2)::int AS Manufacturer_other FROM part")
def f5(spark, sf_dir):
    config = [("FileName", "keep"), ("Not There", "keep"), ("A very long name of a sheet's column", "keep"), ("Manufacturer", "one_hot_encoding_from_str_col")]
    return sheet.training_sheet(_sheet(spark, sf_dir), config)


@query("f6_one_hot_from_array", "SELECT p.p_partkey AS FileName, t.w AS token, contains(replace(p_name, ' ', '_'), t.w)::int AS flag FROM part p, (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) t")
def f6(spark, sf_dir):
    rows = _sheet(spark, sf_dir)
    tokens = sheet.array_tokens(rows, "Image Type")
    wide = rows.select("FileName", *sheet.one_hot_array("Image Type", tokens))
    return wide.select("FileName", F.explode(F.array(*(F.struct(F.lit(t).alias("token"), F.col(f"`Image Type_{t}`").alias("flag")) for t in tokens))).alias("s")).select("FileName", "s.token", "s.flag")


def _ones(rows, column, vocabulary):
    """(FileName, token, index) of all flags that are set."""
    vocabulary = stored(vocabulary, "vocabulary")
    set_flags = sheet.sparse_flags(rows.select("FileName", column), column, vocabulary).select("FileName", F.explode("flags").alias("index"))
    return set_flags.join(vocabulary, "index").select("FileName", "token", "index")


@query("f6_one_hot_sparse", "SELECT p_partkey AS FileName, w AS token, index FROM part, (SELECT w, row_number() OVER (ORDER BY w) - 1 AS index FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)) WHERE contains(replace(p_name, ' ', '_'), w)")
def f6_sparse(spark, sf_dir):
    rows = _sheet(spark, sf_dir)
    return _ones(rows, "Image Type", sheet.array_token_table(rows, "Image Type"))


@query("f7_one_hot_sparse", "SELECT p_partkey AS FileName, v AS token, index FROM part, (SELECT v, row_number() OVER (ORDER BY v) - 1 AS index FROM (SELECT DISTINCT p_type AS v FROM part)) WHERE contains(p_type, v)")
def f7_sparse(spark, sf_dir):
    rows = _sheet(spark, sf_dir)
    return _ones(rows, "MR Acquisition Type", sheet.token_table(rows, "MR Acquisition Type"))


@query("f7_one_hot_from_str", "SELECT p.p_partkey AS FileName, replace(t.v, ' ', '_') AS value, contains(p_type, t.v)::int AS flag FROM part p, (SELECT DISTINCT p_type AS v FROM part) t")
def f7(spark, sf_dir):
    rows = _sheet(spark, sf_dir)
    values = sheet.distinct_values(rows, "MR Acquisition Type")
    wide = rows.select("FileName", *sheet.one_hot_text("MR Acquisition Type", values))
    names = [v.replace(" ", "_") for v in values]
    return wide.select("FileName", F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"`MR Acquisition Type_{v}`").alias("flag")) for v in names))).alias("s")).select("FileName", "s.value", "s.flag")


@query("f8_manufacturer_buckets", f"SELECT p_partkey, CASE WHEN m IS NULL THEN NULL WHEN contains(lower(m), 'siemens') THEN 'siemens' WHEN contains(lower(m), 'ge') THEN 'ge' ELSE 'other' END AS bucket FROM (SELECT p_partkey, {_MAKER} AS m FROM part)")
def f8(spark, sf_dir):
    return _sheet(spark, sf_dir).select(F.col("FileName").alias("p_partkey"), sheet.manufacturer_bucket(F.col("Manufacturer")).alias("bucket"))


@query("f9_dedupe_rows", "SELECT p_partkey, p_name, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def f9(spark, sf_dir):
    return sheet.first_of_each(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "p_partkey")


_DEDUPE_SQL = ", ".join(f"{c} AS \"{n}\"" for n, c in {"Echo Time": "echo_time", "Flip Angle": "flip_angle", "Image Type": "image_type", "Manufacturer": "manufacturer", "Scanning Sequence": "scanning_sequence"}.items())
_LACKED = [f for f in S.DEDUPE_FIELDS if f'"{f}"' not in _DEDUPE_SQL]


@query("f9_dedupe_sheet", f"SELECT FileName FROM (SELECT file_name AS FileName, row_number() OVER (PARTITION BY {', '.join(f'{c}' for c in ('echo_time', 'flip_angle', 'image_type', 'manufacturer', 'scanning_sequence'))} ORDER BY file_name) AS n FROM inst) WHERE n = 1", ("inst",))
def f9_sheet(spark, sf_dir):
    """Rows of one content in all fields that the survey compares; those that the headers lack are null in every row."""
    rows = fixtures.inst(spark, sf_dir).selectExpr("file_name AS FileName", *_DEDUPE_SQL.replace('"', "`").split(", ")).withColumns({f: F.lit(None).cast("string") for f in _LACKED})
    return sheet.first_of_each(rows, S.DEDUPE_FIELDS, "FileName").select("FileName")


@query("f10_unusable_columns", "SELECT * FROM (SELECT 'one' AS \"column\", 1.0e0 AS share, 1::bigint AS n UNION ALL SELECT 'rare', count(CASE WHEN p_partkey % 50 = 0 THEN p_size END) / count(*), count(DISTINCT CASE WHEN p_partkey % 50 = 0 THEN p_size END) FROM part UNION ALL SELECT 'p_type', count(p_type) / count(*), count(DISTINCT p_type) FROM part) WHERE share <= 0.05 OR n < 2")
def f10(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_type", F.lit(1).alias("one"), F.when(F.col("p_partkey") % 50 == 0, F.col("p_size")).alias("rare"))
    return sheet.unusable_columns(rows)


@query("f11_merge_labels", "SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)")
def f11(spark, sf_dir):
    return sheet.merge_labels(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("f12_fill_by_name", "SELECT file_name, coalesce(echo_time, -12345) AS EchoTime, coalesce(CASE WHEN gx = 1 THEN gx END, 0) AS ImageType_X FROM inst WHERE instance_number <> 3", ("inst",))
def f12(spark, sf_dir):
    rows = fixtures.inst(spark, sf_dir).select("file_name", F.when(F.col("instance_number") == 3, float("inf")).otherwise(F.col("echo_time")).alias("EchoTime"), F.when(F.col("gx") == 1, F.col("gx")).alias("ImageType_X"))
    return sheet.filled(rows, ["EchoTime", "ImageType_X"])


_CLASSES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "5-LOW": 3}


@query("f13_label_filter_encode", "SELECT file_name, label, CASE label WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS code FROM inst WHERE label IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')", ("inst",))
def f13(spark, sf_dir):
    return sheet.encode_labels(fixtures.inst(spark, sf_dir).select("file_name", "label"), _CLASSES)


_DATASET = "split_part(study_key, '.', 3) % 2"


@query(
    "f14_orientation_training_set",
    """SELECT file_name, (split_part(i.study_key, '.', 3)::bigint % 2)::int AS dataset, i.iop_0, i.iop_1, i.iop_2, i.iop_3, i.iop_4, CASE WHEN i.echo_time IS NOT NULL THEN i.iop_5 END AS iop_5, CASE s.orientation WHEN 'ax' THEN 0 WHEN 'cor' THEN 1 ELSE 2 END AS code
FROM inst i JOIN (SELECT series_uid, CASE WHEN pixel_bandwidth IS NULL THEN 'INVALID' WHEN abs(iop_5) <= 0.5 THEN 'ax' WHEN abs(iop_0) <= 0.707 THEN 'sag' ELSE 'cor' END AS orientation FROM vol WHERE volume_index = 0) s USING (series_uid) WHERE i.echo_time IS NOT NULL AND orientation <> 'INVALID'""",
    B.VOL,
)
def f14(spark, sf_dir):
    return _orientation_rows(spark, sf_dir).select("file_name", "dataset", *grouping.DIRECTION, "code")


def _dataset():
    return F.expr(_DATASET).cast("int").alias("dataset")


def _orientation_rows(spark, sf_dir):
    """Two datasets, told apart by their studies; the labels are the planes of the series' first volumes."""
    files = fixtures.inst(spark, sf_dir).select("file_name", "series_uid", _dataset(), *grouping.DIRECTION[:5], F.when(F.col("echo_time").isNotNull(), F.col("iop_5")).alias("iop_5"))
    labels = B.volumes(spark, sf_dir).where("volume_index = 0").select("series_uid", _dataset(), F.col("plane").alias("orientation"))
    return sheet.orientation_set(files, labels, ["dataset", "series_uid"], grouping.DIRECTION, ["file_name"])


# Training

_FEATURES = S.FEATURES
#: Features that the headers hold as measured; what they do not hold is filled by name.
_HELD = {"EchoTime": "echo_time", "FlipAngle": "flip_angle", "PixelBandwidth": "pixel_bandwidth", "RepetitionTime": "repetition_time"}


def _coded_rows(spark, sf_dir):
    files = B.coded(fixtures.inst(spark, sf_dir, numbered=False))
    value_of = lambda f: F.col(f"`{_HELD.get(f, f)}`") if _HELD.get(f, f) in files.columns else F.lit(None)
    features = [value_of(f).cast("double").alias(f) for f in _FEATURES]
    rows = sheet.filled(files.select("file_name", "label", *features, "instance_number"), _FEATURES)
    return sheet.encode_labels(rows, {**_CLASSES, "4-NOT SPECIFIED": 4})


@query("g1_unique_feature_rows", "SELECT file_name, flip_angle, slice_thickness, iop_0 FROM (SELECT *, row_number() OVER (PARTITION BY flip_angle, slice_thickness, iop_0 ORDER BY file_name) AS n FROM inst) WHERE n = 1", ("inst",))
def g1(spark, sf_dir):
    return training.unique_rows(fixtures.inst(spark, sf_dir).select("file_name", "flip_angle", "slice_thickness", "iop_0"), ["flip_angle", "slice_thickness", "iop_0"], "file_name")


@query("g2_stratified_split", "SELECT file_name, label, row_number() OVER (PARTITION BY label ORDER BY md5(file_name), file_name) <= floor(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM inst", ("inst",))
def g2(spark, sf_dir):
    key = F.concat(F.md5(F.col("file_name")), "file_name")
    return training.stratified_split(fixtures.inst(spark, sf_dir).select("file_name", "label"), "label", key, 0.2)


@query("g3_balance_classes", "SELECT label, count(*) AS n, count(DISTINCT file_name) AS n_files, max(copy)::int AS copies FROM (SELECT label, file_name, unnest(range(0, (floor((2000 - r) / c) + 1)::bigint)) AS copy FROM (SELECT label, file_name, row_number() OVER (PARTITION BY label ORDER BY file_name) AS r, count(*) OVER (PARTITION BY label) AS c FROM inst) WHERE r <= 2000) GROUP BY 1", ("inst",))
def g3(spark, sf_dir):
    rows = training.balanced(fixtures.inst(spark, sf_dir).select("file_name", "label"), "label", "file_name", 2000)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("n_files"), F.max("copy").alias("copies"))


def _model_rows(spark, sf_dir, n=800):
    return stored(training.balanced(_coded_rows(spark, sf_dir), "code", "file_name", n).drop("copy"), "balanced")


@query("g4_train_forest")
def g4(spark, sf_dir):
    model = training.train_forest(_model_rows(spark, sf_dir), _FEATURES)
    return model.transform(training.assembled(_coded_rows(spark, sf_dir), _FEATURES)).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("g4_train_and_test")
def g4_tested(spark, sf_dir):
    """The whole training: unique feature rows, 80/20 by class, balanced training rows, a forest, and the report on the rows that it never saw."""
    unique = training.unique_rows(_coded_rows(spark, sf_dir), _FEATURES, "file_name")
    rows = stored(training.stratified_split(unique, "code", F.xxhash64("file_name"), 0.2), "unique")
    model = training.train_forest(training.balanced(rows.where("NOT is_test"), "code", "file_name", 800), _FEATURES)
    return training.classification_report(classify.score(rows.where("is_test"), model, _FEATURES, _LABELS), "label", "GUESS_ONNX")


@query("g5_one_vs_rest")
def g5(spark, sf_dir):
    model = training.train_one_vs_rest(_model_rows(spark, sf_dir), _FEATURES)
    return forests.counted(model, model.models, _coded_rows(spark, sf_dir), _FEATURES, "label", list(_LABELS))


_PREDICTED = "CASE WHEN l_quantity < 10 THEN '1-URGENT' WHEN l_quantity < 25 THEN '2-HIGH' WHEN l_quantity < 40 THEN '5-LOW' ELSE o_orderpriority END"


def _predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderpriority").alias("label"), F.expr(_PREDICTED).alias("prediction"), "l_linenumber")


_PRED_SQL = f"SELECT o_orderpriority AS label, {_PREDICTED} AS prediction, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("g6_confusion_matrix", f"SELECT label, prediction, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 2) AS share FROM ({_PRED_SQL}) GROUP BY label, prediction")
def g6(spark, sf_dir):
    return training.confusion(_predictions(spark, sf_dir), "label", "prediction")


@query(
    "g7_classification_report",
    f"""WITH p AS ({_PRED_SQL}), c AS (SELECT class, sum((side = 'l')::int)::bigint AS support, sum((side = 'p')::int)::bigint AS said, sum((side = 'l' AND ok)::int)::bigint AS r FROM (SELECT label AS class, 'l' AS side, label = prediction AS ok FROM p UNION ALL SELECT prediction, 'p', false FROM p) GROUP BY 1),
m AS (SELECT class, CASE WHEN said > 0 THEN r / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN r / support ELSE 0 END AS recall, support FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint FROM f""",
)
def g7(spark, sf_dir):
    return training.classification_report(_predictions(spark, sf_dir), "label", "prediction").select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("g8_feature_importance")
def g8(spark, sf_dir):
    return training.importances(spark, training.train_forest(_model_rows(spark, sf_dir), _FEATURES), _FEATURES)


@query("g9_k_fold", "SELECT label, ((row_number() OVER (PARTITION BY label ORDER BY file_name) - 1) % 5)::int AS fold, file_name FROM inst", ("inst",))
def g9(spark, sf_dir):
    return training.with_folds(fixtures.inst(spark, sf_dir).select("label", "file_name"), "label", "file_name", 5)


@query("g9_k_fold_models")
def g9_models(spark, sf_dir):
    rows = stored(training.with_folds(_model_rows(spark, sf_dir), "code", "file_name", 5), "folds")
    accuracies, _ = training.cross_validate(rows, _FEATURES, 5)
    return spark.createDataFrame(list(enumerate(accuracies)), "fold int, accuracy double")


@query("g10_std_progression", f"SELECT l_linenumber AS fold, round(accuracy, 6) AS accuracy, round(stddev_pop(accuracy) OVER (ORDER BY l_linenumber), 6) AS spread FROM (SELECT l_linenumber, avg((label = prediction)::int) AS accuracy FROM ({_PRED_SQL}) GROUP BY 1)")
def g10(spark, sf_dir):
    accuracy = _predictions(spark, sf_dir).groupBy(F.col("l_linenumber").alias("fold")).agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"))
    return training.spread_so_far(accuracy).select("fold", F.round("accuracy", 6).alias("accuracy"), F.round("spread", 6).alias("spread"))


_LABELS = {**_CLASSES, "4-NOT SPECIFIED": 4}


def _scored(spark, sf_dir, rows=None):
    model = training.train_forest(_model_rows(spark, sf_dir), _FEATURES)
    return classify.score(_coded_rows(spark, sf_dir) if rows is None else rows, model, _FEATURES, _LABELS)


@query("d6_score_modality")
def d6(spark, sf_dir):
    return _scored(spark, sf_dir).select("file_name", "volume_modality", "GUESS_ONNX_CODE")


@query("d7_label_decode")
def d7(spark, sf_dir):
    return _scored(spark, sf_dir).select("file_name", "GUESS_ONNX", "GUESS_ONNX_CODE", *(f"`GUESS_ONNX_{n}`" for n in _LABELS))


@query("g11_batch_inference")
def g11(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("label", "GUESS_ONNX").agg(F.count("*").alias("n"))


@query("g12_metric_test")
def g12(spark, sf_dir):
    known = _coded_rows(spark, sf_dir).where(F.col("label") != "4-NOT SPECIFIED").drop("PixelBandwidth")  # a sheet that lacks a feature
    return training.classification_report(_scored(spark, sf_dir, sheet.filled(known, _FEATURES)), "label", "GUESS_ONNX")


_GRID_TREES, _GRID_DEPTHS = [1, 10, 25, 50, 75, 100, 150, 200], [1, 2, 4, 6, 8, 10, 12, 15, 20, 25, 30]


@query("g13_grid_search")
def g13(spark, sf_dir):
    rows = _model_rows(spark, sf_dir, 5000)
    return training.grid_accuracies(rows, _FEATURES, _GRID_TREES, _GRID_DEPTHS, 5)


@query("g14_orientation_train")
def g14(spark, sf_dir):
    # Each dataset is split 70/30, and both are stacked; the tree and the forest.
    names = grouping.DIRECTION
    rows = stored(training.stratified_split(_orientation_rows(spark, sf_dir), "dataset", F.xxhash64("file_name"), 0.3), "oriented")
    taught, asked = rows.where("NOT is_test"), training.assembled(rows.where("is_test"), names)
    scored = [training.train_orientation(taught, names, tree).transform(asked).withColumn("model", F.lit("tree" if tree else "forest")) for tree in (True, False)]
    return scored[0].unionByName(scored[1]).groupBy("model", "dataset", "code", "prediction").agg(F.count("*").alias("n"))


@query(
    "g15_threshold_rules",
    """SELECT t1, t2, round(avg((CASE WHEN iop_5 <= t1 THEN 'ax' WHEN iop_0 <= t2 THEN 'sag' ELSE 'cor' END = plane)::int), 6) AS first_tree, round(avg((CASE WHEN iop_5 <= t1 THEN 'ax' WHEN iop_0 * 0.5 <= t2 THEN 'cor' ELSE 'sag' END = plane)::int), 6) AS second_tree
FROM coded, (VALUES (0.5e0, 0.5e0), (0.5e0, 0.707e0), (0.707e0, 0.5e0), (0.707e0, 0.707e0)) t(t1, t2) GROUP BY t1, t2""",
    B.CODED,
)
def g15(spark, sf_dir):
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2")) for a in (0.5, 0.707) for b in (0.5, 0.707))))
    rows = B.volumes(spark, sf_dir).select("plane", "iop_0", "iop_5", pairs.alias("t"))
    one, two = training.threshold_rules(F.col("iop_0"), F.col("iop_0") * 0.5, F.col("iop_5"), F.col("t.t1"), F.col("t.t2"))
    share = lambda p: F.round(F.avg((p == F.col("plane")).cast("int")), 6)
    return rows.groupBy("t.t1", "t.t2").agg(share(one).alias("first_tree"), share(two).alias("second_tree"))


@query("g16_orientation_inference")
def g16(spark, sf_dir):
    model = training.train_orientation(_orientation_rows(spark, sf_dir), grouping.DIRECTION)
    asked = fixtures.inst(spark, sf_dir).select("file_name", F.when(F.col("echo_time").isNotNull(), F.col("iop_0")).alias("iop_0"), *grouping.DIRECTION[1:]).fillna(-1000000.0)
    return model.transform(training.assembled(asked, grouping.DIRECTION)).select("file_name", "prediction")


# Voxels

_V, _T = f"v AS ({fixtures.VOXELS})", f"v AS ({fixtures.THIN})"


def _rounded(frame, *names):
    return frame.withColumns({n: F.round(n, 4) for n in names})


@query("h1_average_by_bvalue", f"WITH {_V} SELECT series, bvalue, z, y, x, round(avg(v), 4) AS v FROM v GROUP BY ALL")
def h1(spark, sf_dir):
    return _rounded(voxels.average_by_b(fixtures.voxels(spark, sf_dir)), "v")


@query("h2_collapse_thin_stack", f"WITH {_T}, d AS (SELECT series, max(z) - min(z) + 1 AS depth FROM v GROUP BY 1) SELECT series, bvalue, (CASE WHEN depth < 10 THEN 0 ELSE z END)::int AS z, y, x, round(avg(v), 4) AS v FROM v JOIN d USING (series) GROUP BY ALL")
def h2(spark, sf_dir):
    return _rounded(voxels.collapse_thin(fixtures.voxels(spark, sf_dir, thin=True)), "v")


@query("h3_trace_image", f"WITH {_V}, a AS (SELECT series, bvalue, z, y, x, avg(v) AS v FROM v GROUP BY ALL), n AS (SELECT series, bvalue FROM (SELECT series, bvalue, row_number() OVER (PARTITION BY series ORDER BY abs(bvalue - 1000), bvalue) AS k FROM (SELECT DISTINCT series, bvalue FROM a)) WHERE k = 1) SELECT series, bvalue, z, y, x, round(v, 4) AS v FROM a JOIN n USING (series, bvalue)")
def h3(spark, sf_dir):
    return _rounded(voxels.trace(voxels.average_by_b(fixtures.voxels(spark, sf_dir))), "v")


@query("h4_adc_multi", f"WITH {_V} SELECT series, z, y, x, round(greatest(0, -1e6 * regr_slope(ln(v + 1e-6), bvalue)), 3) AS adc FROM v GROUP BY ALL")
def h4(spark, sf_dir):
    return voxels.adc_slope(fixtures.voxels(spark, sf_dir)).withColumn("adc", F.round("adc", 3))


_A = f"{_V}, a AS (SELECT series, bvalue, z, y, x, avg(v) AS v FROM v GROUP BY ALL)"


@query("h5_adc_two_point", f"WITH {_A} SELECT series, z, y, x, round(greatest(0, 1e6 * ln((arg_min(v, bvalue) + 1e-6) / (arg_max(v, bvalue) + 1e-6)) / (max(bvalue) - min(bvalue))), 3) AS adc FROM a GROUP BY ALL")
def h5(spark, sf_dir):
    return voxels.adc_two_point(voxels.average_by_b(fixtures.voxels(spark, sf_dir))).withColumn("adc", F.round("adc", 3))


@query(
    "h6_voxel_arithmetic",
    f"""WITH {_A}, lo AS (SELECT * FROM a WHERE bvalue = 0), hi AS (SELECT series, z, y, x, v AS w FROM a WHERE bvalue = 1000), s AS (SELECT series, z, y, x, sum(v) AS total FROM a GROUP BY ALL)
SELECT series, z, y, x, round(ln(v + 1e-6), 4) AS log_v, round(exp(v / 1000), 4) AS exp_v, round(v + w, 4) AS added, round(v + 5, 4) AS raised, round(v - w, 4) AS subtracted, round(v / (w + 1), 4) AS divided, round(v * 0.5, 4) AS scaled, round(least(greatest(v, 50), 100), 4) AS clamped, round(total, 4) AS total FROM lo JOIN hi USING (series, z, y, x) JOIN s USING (series, z, y, x)""",
)
def h6(spark, sf_dir):
    averages = voxels.average_by_b(fixtures.voxels(spark, sf_dir))
    pairs = voxels.joined(averages.where("bvalue = 0"), averages.where("bvalue = 1000")).join(voxels.total(averages).withColumnRenamed("v", "total"), voxels.PLACE)
    v, w = F.col("v"), F.col("w")
    made = {"log_v": F.log(v + voxels.EPSILON), "exp_v": F.exp(v / 1000), "added": v + w, "raised": v + 5, "subtracted": v - w, "divided": v / (w + 1), "scaled": v * 0.5, "clamped": voxels.clamp(v, 50.0, 100.0), "total": F.col("total")}
    return pairs.select(*voxels.PLACE, *(F.round(c, 4).alias(n) for n, c in made.items()))


@query("h7_min_max", f"WITH {_V} SELECT image, min(v) AS low, max(v) AS high FROM v GROUP BY 1")
def h7(spark, sf_dir):
    return voxels.min_max(fixtures.voxels(spark, sf_dir))


@query("h8_center_slice", f"WITH {_V}, d AS (SELECT image, max(z) + 1 AS depth FROM v GROUP BY 1) SELECT image, z, y, x, round(least(greatest((v - 0) / 300 * 255, 0), 255))::int AS byte FROM v JOIN d USING (image) WHERE z = depth // 2")
def h8(spark, sf_dir):
    return voxels.center_slice(fixtures.voxels(spark, sf_dir), 0.0, 300.0)


@query("h9_voxel_diff", f"WITH {_V}, d AS (SELECT a.image, a.z, a.y, a.x, min(abs(a.v - b.v * 1.05)) AS d FROM v a LEFT JOIN v b ON a.image = b.image AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT image, sum((d > 1.5)::int)::bigint AS n_differing FROM d GROUP BY 1")
def h9(spark, sf_dir):
    v = fixtures.voxels(spark, sf_dir).select("image", "z", "y", "x", "v")
    return voxels.differing(v, v.withColumn("v", F.col("v") * 1.05), "image", 1.5, 1)


@query("h10_read_dwi", f"WITH RECURSIVE {B.WITH['inst'].removeprefix('RECURSIVE ')}, {B.WITH['split']}, {B.WITH['vol']}, {B.WITH['coded']}, {_V} SELECT c.file_name, c.b_value, count(*) AS n_voxels, round(sum(v.v), 2) AS total FROM coded c JOIN v ON v.image = c.series_number AND c.volume_index = 0 GROUP BY 1, 2")
def h10(spark, sf_dir):
    vols = B.volumes(spark, sf_dir).where("volume_index = 0")
    v = fixtures.voxels(spark, sf_dir).groupBy("image").agg(F.count("*").alias("n_voxels"), F.sum("v").alias("total"))
    return vols.join(v, F.col("series_number") == F.col("image")).select("file_name", "b_value", "n_voxels", F.round("total", 2).alias("total"))


@query("h11_zero_pixels", f"WITH {_V} SELECT image, count(*) AS n, 0.0e0 AS total FROM v GROUP BY 1")
def h11(spark, sf_dir):
    return voxels.zeroed(fixtures.voxels(spark, sf_dir)).groupBy("image").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


# De-identification


@query("i1_remap_uids", "SELECT study_key, count(DISTINCT series_identifier) AS n_series, count(DISTINCT file_name) AS n_files, 1::bigint AS n_studies FROM inst GROUP BY 1", ("inst",))
def i1(spark, sf_dir):
    new = deid.remapped(fixtures.inst(spark, sf_dir), "salt", "study_key", "series_identifier", "file_name")
    return new.groupBy("study_key").agg(F.count_distinct("new_series").alias("n_series"), F.count_distinct("new_instance").alias("n_files"), F.count_distinct("new_study").alias("n_studies"))


@query(
    "i2_deidentify_headers",
    "SELECT file_name, 'ANON' AS study, (gx IS NOT NULL)::int AS has_gradient, (bvalue_raw IS NOT NULL)::int AS has_b, false AS has_private, coalesce(contrast_agent, '') AS agent FROM inst",
    ("inst",),
)
def i2(spark, sf_dir):
    extra = F.map_concat("tags", F.create_map(F.lit("00091001"), F.element_at(F.col("tags"), "0020000D")))
    out = deid.deidentified(fixtures.tagged(fixtures.inst(spark, sf_dir)).withColumn("tags", extra), ["0020000D", "0020000E", "00180010"])
    tags = F.col("tags")
    has = lambda *names: F.greatest(*(F.map_contains_key(tags, n).cast("int") for n in names))
    return out.select("file_name", value(tags, "0020000D").alias("study"), F.map_contains_key(tags, "00189076").cast("int").alias("has_gradient"), has("0019100C", "00431039", "20011003", "00189087").alias("has_b"), F.map_contains_key(tags, "00091001").alias("has_private"), F.coalesce(value(tags, "00180010"), F.lit("")).alias("agent"))


@query(
    "i3_bids_manifest",
    """SELECT file_name, 'sub-' || study_key || '/ses-' || coalesce(d, only_date) || '/' || series_number AS target FROM (SELECT *, CASE WHEN len(ds) = 1 THEN ds[1] END AS only_date FROM (
SELECT i.file_name, i.study_key, i.series_number, CASE WHEN i.acquisition_number > 0 THEN strftime(i.acquisition_datetime, '%Y%m01') END AS d, s.ds FROM inst i JOIN (SELECT study_key, list(DISTINCT strftime(acquisition_datetime, '%Y%m01')) FILTER (acquisition_number > 0) AS ds FROM inst GROUP BY 1) s USING (study_key) WHERE len(s.ds) > 0)) WHERE d IS NOT NULL OR only_date IS NOT NULL""",
    ("inst",),
)
def i3(spark, sf_dir):
    files = fixtures.inst(spark, sf_dir).withColumns({"path": F.concat(F.lit("/in/"), "study_key", F.lit("_x/a/b/"), "file_name"), "date": F.when(F.col("acquisition_number") > 0, F.date_format("acquisition_datetime", "yyyyMM01"))})
    dated = files.join(files.where("date IS NOT NULL").select("study_key").distinct(), "study_key")
    return deid.bids_targets(dated, "path", "study_key", "date", "series_number").select("file_name", "target")
