import datetime

import pytest
from mrloom import schema as S
from mrloom.operators import classify, deid, grouping, ranks, sheet, training, voxels
from mrloom.sources import headers, sinks
from pyspark.sql import functions as F

FILE = "study_key string, series_identifier string, series_number int, file_name string, ipp_x double, ipp_y double, ipp_z double, acquisition_datetime timestamp_ntz, acquisition_number int, instance_number int"
T = datetime.datetime(2020, 1, 1)


AXIAL, SAGITTAL, CORONAL = [1, 0, 0, 0, 1, 0], [0, 1, 0, 0, 0, -1], [1, 0, 0, 0, 0, -1]


def files(spark, positions, series="s", number=1, directions=AXIAL):
    """positions: z of axial slices, or whole positions."""
    whole = [p if isinstance(p, tuple) else (None, None, None) if p is None else (0, 0, p) for p in positions]
    rows = [("st", series, number, f"f{i:02d}", *(None if v is None else float(v) for v in p), T, None, i) for i, p in enumerate(whole)]
    return spark.createDataFrame(rows, FILE).withColumns({f"iop_{i}": F.lit(float(v)) for i, v in enumerate(directions)})


def sub_volumes(frame):
    return [r["sub_volume"] for r in grouping.split_volumes(frame).orderBy("file_name").collect()]


def test_split(spark):
    assert sub_volumes(files(spark, [0, 1, 2])) == [0, 0, 0]
    assert sub_volumes(files(spark, [0, 1, 0, 1])) == [0, 0, 1, 1]
    assert sub_volumes(files(spark, [0, 1, 0, 1, 0])) == [0, 0, 1, 1, None]
    assert sub_volumes(files(spark, [0, 0, 0, 1])) == [0, 0, 0, 0]  # a position is short: one volume of all
    with pytest.raises(Exception, match="uneven"):
        grouping.split_volumes(files(spark, [0, 1, 0]), strict=True).collect()


def test_positions_are_whole_and_slices_follow_the_normal(spark):
    """Sagittal slices share z, coronal ones too; six of them are one volume, and its files go along the normal."""
    for directions, at, forward in ((SAGITTAL, lambda k: (k, 7, 7), False), (CORONAL, lambda k: (7, k, 7), True), (AXIAL, lambda k: (7, 7, k), True)):
        split = grouping.split_volumes(files(spark, [at(k) for k in (3, 0, 5, 1, 4, 2)], directions=directions))
        (vol,) = grouping.volumes(split).collect()
        order = ["f01", "f03", "f05", "f00", "f04", "f02"]
        assert (vol["n_slices"], vol["files"]) == (6, order if forward else order[::-1])
        assert [r["file_name"] for r in grouping.volume_headers(split).collect()] == [vol["file_name"]] == vol["files"][:1]
        twice = grouping.volumes(grouping.split_volumes(files(spark, [at(k) for k in (0, 1, 0, 1)], directions=directions))).orderBy("volume_index").collect()
        assert [sorted(r["files"]) for r in twice] == [["f00", "f01"], ["f02", "f03"]]
    tied = grouping.volumes(grouping.split_volumes(files(spark, [(1, 0, 0), (0, 1, 0)]))).first()
    assert tied["files"] == ["f00", "f01"]  # both at one place along the normal


def test_every_file_is_in_one_volume_at_most(spark):
    from mrloom.plans import base

    split = base.split(spark, "/root/testdata/sf0.001")
    vols = grouping.volumes(split).cache()
    listed = vols.select(F.explode("files").alias("f"))
    assert listed.count() == listed.distinct().count() == split.where("sub_volume IS NOT NULL").count()
    bad = split.groupBy("series_identifier").agg(F.max("n_volumes").alias("v"), F.max("n_positions").alias("p")).where("v > 1").join(vols.select("series_identifier", F.size("files").alias("n")), "series_identifier").where("n <> p")
    assert bad.count() == 0


def test_positions_and_quarantine(spark):
    frame = files(spark, [0, None, 1, None])
    assert [r["ipp_z"] for r in grouping.with_positions(frame).orderBy("file_name").collect()] == [0, 1, 1, 3]
    late = files(spark, [None, (5, 5, 5), (5, 5, 5), None, (6, 5, 5), None])
    made = grouping.with_positions(late).orderBy("file_name").collect()
    assert [(r["ipp_x"], r["ipp_y"], r["ipp_z"], r["is_synthetic"]) for r in made] == [(0, 0, 0, True), (5, 5, 5, False), (5, 5, 5, False), (0, 0, 2, True), (6, 5, 5, False), (0, 0, 4, True)]
    with pytest.raises(Exception, match="no position"):
        grouping.with_positions(frame, strict=True).collect()
    lost = files(spark, [0, 1], number=None)
    assert grouping.quarantine(lost).count() == 2 and grouping.volumes(grouping.split_volumes(lost)).count() == 0


def rolled(spark, vols):
    rows = [("st", 1, "s", i, m, b, g, it, "ax", True, False, perf) for i, (m, b, g, it, perf) in enumerate(vols)]
    frame = spark.createDataFrame(rows, "study_key string, series_number int, series_identifier string, volume_index int, volume_modality string, b_value double, gradient string, image_type string, plane string, isotropic boolean, contrast boolean, perfusion int")
    return classify.roll_up(frame).first()["series_modality"]


def test_roll_up(spark):
    n = -12345.0
    assert rolled(spark, [("LOW_PROBABILITY_t1w", n, None, "x", 0)]) == "t1w"
    assert rolled(spark, [("t1w", 100.0, None, "x", 0)]) == "tracew"
    assert rolled(spark, [("t1w", 100.0, None, None, 0)]) == "MISSING_IMAGE_TYPE"
    assert rolled(spark, [("LOW_PROBABILITY_t1w", n, None, "x", 0), ("t1w", n, None, "x", 0)]) == "LOW_PROBABILITY_t1w"
    assert rolled(spark, [("b0", 0.0, g, "x", 0) for g in "abc"]) == "dwig"
    assert rolled(spark, [("pd", n, None, "x", 0), ("t2w", n, None, "x", 0), ("dwig", n, None, "x", 0)]) == "PDT2"
    assert rolled(spark, [("b0", n, None, "x", 0), ("tracew", n, None, "x", 0)]) == "tracew"
    assert rolled(spark, [("b0", 0.0, None, "x", 0), ("t1w", 10.0, None, "x", 0)]) == "tracew"
    assert rolled(spark, [("b0", n, None, "x", 0), ("t1w", 10.0, None, "x", 0)]) == "b0"
    assert rolled(spark, [("dwig", 0.0, None, "x", 0), ("t1w", 0.0, None, "x", 1)]) == "perfusion"


def repaired(spark, series):
    rows = [("st", n, m, b, s) for n, m, b, s in series]
    frame = spark.createDataFrame(rows, "study_key string, series_number int, series_modality string, first_b_value double, space int")
    return {r["series_number"]: r["series_modality"] for r in classify.repair_neighbours(frame, ["space"]).collect()}


def test_repair_runs_forward_along_a_chain_only(spark):
    assert repaired(spark, [(6, "tracew", 1000.0, 1), (7, "b0", 0.0, 1), (8, "b0", 0.0, 1)]) == {6: "tracew", 7: "tracew", 8: "tracew"}
    assert repaired(spark, [(4, "b0", 0.0, 1), (5, "b0", 0.0, 1), (6, "tracew", 1000.0, 1)]) == {4: "b0", 5: "tracew", 6: "tracew"}
    assert repaired(spark, [(6, "tracew", 1000.0, 1), (7, "b0", 0.0, 2), (9, "b0", 0.0, 1)]) == {6: "tracew", 7: "b0", 9: "b0"}
    assert repaired(spark, [(5, "adc", 0.0, 1), (6, "tracew", 1000.0, 1), (7, "t1w", -12345.0, 1)]) == {5: "adc", 6: "tracew", 7: "t1w"}


def test_scan_and_sinks(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.json").write_text('{"00080070": {"vr": "LO", "Value": ["SIEMENS"]}, "00189087": {"vr": "FD", "Value": [1000]}}')
    (tmp_path / "a" / "b" / "y.json").write_text("no header")
    scanned = headers.scan_headers(spark, str(tmp_path / "a"))
    assert headers.project(scanned, ["Manufacturer", "SAR"]).first()["Manufacturer"] == "SIEMENS"
    assert headers.unreadable_headers(spark, str(tmp_path / "a")).count() == 1
    studies = spark.createDataFrame([("st",), ("none",)], "study_key string")
    assert [r["message"] for r in headers.without_headers(studies, files(spark, [0])).collect()] == ["No headers in: none"]
    with pytest.raises(Exception, match="No headers"):
        headers.without_headers(studies, files(spark, [0]), strict=True).collect()
    reports = spark.createDataFrame([("one",), ("",)], "report string")
    for _ in range(2):
        sinks.append_report(reports, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    sinks.write_results(spark.createDataFrame([("10",), ("2",)], "n string"), str(tmp_path / "csv"), ["n"])
    assert [r["n"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["10", "2"]
    sinks.write_sheet(reports, str(tmp_path / "~$skip.parquet"))
    sinks.write_sheet(reports.withColumn("n", F.lit(1)), str(tmp_path / "s.parquet"))
    assert headers.read_sheets(spark, [str(tmp_path / "~$skip.parquet"), str(tmp_path / "s.parquet")]).columns == ["report", "n"]
    with pytest.raises(ValueError, match="unknown kind"):
        headers.read_sheets(spark, [str(tmp_path / "x.xyz")])


def test_session_text_is_json(spark):
    import json

    rows = spark.createDataFrame([("st", "1_0", "t1w", 'a "q" \\'), ("st", "10_0", "INVALID", "b")], "study string, key string, VolumeModality string, d string")
    text = sinks.session_text(rows, "study", "key", ["d", "VolumeModality"], F.col("VolumeModality") != "INVALID").first()["json"]
    want = {"st": {"10_0": {}, "1_0": {"VolumeModality": "t1w", "d": 'a "q" \\'}}}
    assert json.loads(text) == want and text == json.dumps(want, indent=4, sort_keys=True)


def test_organized_and_failures(spark):
    vols = spark.createDataFrame([("st", 5, 1, "tracew", 1000.0, ["a"], "tracew", "cor")], "study_key string, series_number int, volume_index int, series_modality string, b_value double, files array<string>, volume_modality string, plane string")
    assert sinks.organized(vols, "o").first()["target"] == "o/0005_001_tracew_b1000/a"
    found = classify.failures([("no ax", F.col("plane") == "ax"), ("no ax", F.col("plane") == "ax"), ("fine", F.lit(True))])
    row = vols.withColumn("f", found).withColumn("r", classify.failure_report(F.col("f"))).first()
    assert row["f"] == ["no ax"] and row["r"].endswith("Failure Messages:\n\tno ax") and "tracew-cor" in row["r"]


def test_sheets(spark):
    rows = spark.createDataFrame([(1, "ORIGINAL_A/M", None), (2, None, 3.0), (3, "M", float("inf"))], "FileName int, `Image Type` string, `Echo Time` double")
    assert sheet.array_tokens(rows, "Image Type") == ["A", "M", "ORIGINAL"]
    assert {r["FileName"]: r["Echo Time"] for r in sheet.filled(rows, ["Echo Time"]).collect()} == {1: -12345.0, 2: 3.0}
    assert sheet.first_of_each(rows, ["no such"], "FileName") is rows
    assert sheet.first_of_each(rows.withColumn("k", F.lit(None).cast("int")), ["k"], "FileName").count() == 1
    assert sheet.ordered_columns(["x", "SeriesNumber", "FileName", "x"]) == ["FileName", "SeriesNumber", "x"]


def test_shares_and_splits(spark):
    rows = spark.range(100).withColumn("label", F.when(F.col("id") < 10, "a").otherwise("b"))
    split = training.stratified_split(rows, "label", F.col("id"), 0.2)
    assert {r["label"]: r["n"] for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 18}
    assert {r["label"]: r["count"] for r in training.balanced(rows, "label", "id", 25).groupBy("label").count().collect()} == {"a": 25, "b": 25}
    cells = training.confusion(rows.withColumn("p", F.lit("a")), "label", "p")
    assert all(abs(r["s"] - 1) < 1e-9 for r in cells.groupBy("label").agg(F.sum("share").alias("s")).collect())
    folds = training.with_folds(rows, "label", "id", 5).groupBy("label", "fold").count().collect()
    assert sorted({r["count"] for r in folds}) == [2, 18]


def test_forest_and_scores(spark):
    rows = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.when(F.col("id") < 100, 0).otherwise(1).alias("code"))
    model = training.train_forest(rows, ["x", "y"], trees=5, depth=3)
    scored = classify.score(rows, model, ["x", "y"], {"low": 0, "high": 1})
    assert scored.where((F.col("GUESS_ONNX_CODE") == F.col("code"))).count() > 195
    assert abs(scored.select(F.col("GUESS_ONNX_low") + F.col("GUESS_ONNX_high")).first()[0] - 1) < 1e-9


def test_voxel_rules(spark):
    v = spark.createDataFrame([("s", b, 0, 0, 0, 1000 * 2.718281828 ** (-b / 1000)) for b in (0.0, 500.0, 1000.0)], "series string, bvalue double, z int, y int, x int, v double")
    assert abs(voxels.adc_slope(v).first()["adc"] - 1000) < 1e-2 and abs(voxels.adc_two_point(v).first()["adc"] - 1000) < 1e-2
    assert voxels.trace(voxels.average_by_b(v).where("bvalue <> 1000"), 250.0).first()["bvalue"] == 0.0


def test_deidentification(spark):
    rows = spark.createDataFrame([("a", {"0020000D": ("UI", ["1.2"], None), "00091001": ("LO", ["x"], None), "0019100C": ("IS", ["5"], None)})], "file_name string, tags map<string,struct<vr:string,Value:array<string>,InlineBinary:string>>")
    kept = deid.deidentified(rows, ["0020000D"]).first()["tags"]
    assert set(kept) == {"0020000D", "0019100C"} and kept["0020000D"]["Value"] == ["ANON"]
    assert len(S.KEPT_TAGS) == 39 and len(S.PERSONAL) == 89 and len(S.FEATURES) == 28
    uid = lambda k: spark.range(1).select(deid.new_uid("s", F.lit(k))).first()[0]
    assert uid("a") == uid("a") != uid("b") and uid("a").startswith("2.25.") and len(uid("a")) <= 64


def test_bids(spark):
    rows = spark.createDataFrame([("/r/sub1_x/a/b/f", "s1", "20200101", 3), ("/r/sub1_x/a/b/g", "s1", None, 3), ("/r/sub2/a/b/h", "s2", None, 4), ("/r/s3/a/b/i", "s3", None, 1), ("/r/s3/a/b/j", "s3", "1", 1), ("/r/s3/a/b/k", "s3", "2", 1)], "path string, study string, date string, n int")
    got = {r["path"][-1]: r["target"] for r in deid.bids_targets(rows, "path", "study", "date", "n").collect()}
    assert got["f"] == got["g"] == "sub-sub1/ses-20200101/3" and set(got) == {"f", "g", "h", "j", "k"} and got["h"].startswith("sub-sub2/ses-")


def test_isotropy_and_contrast_are_those_of_the_first_volume(spark):
    schema = "study_key string, series_number int, volume_index int, is_valid boolean, plane string, isotropic boolean, contrast boolean"
    rows = [("a", 1, 0, True, "ax", True, False), ("a", 1, 1, True, "cor", False, True), ("a", 1, 2, False, "ax", False, True), ("a", 2, 0, False, "ax", True, True), ("a", 2, 1, True, "sag", True, True)]
    got = {(r["series_number"], r["volume_index"]): (r["plane"], r["isotropic"], r["contrast"]) for r in classify.decided_by_series(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 0): ("ax", True, False), (1, 1): ("cor", True, False), (1, 2): ("INVALID", False, False), (2, 0): ("INVALID", False, False), (2, 1): ("sag", None, False)}


def test_uids_have_124_bits_and_keep_to_their_keys(spark):
    from mrloom.operators import deid

    rows = spark.range(2000).select(deid.new_uid("salt", F.col("id").cast("string")).alias("u"), deid.new_uid("salt", F.col("id").cast("string")).alias("v")).collect()
    assert len({r["u"] for r in rows}) == 2000 and all(r["u"] == r["v"] for r in rows)
    numbers = [int(r["u"].removeprefix("2.25.")) for r in rows]
    assert max(numbers) > 1 << 123 and all(n < 1 << 124 for n in numbers)


def test_large_vocabularies_are_an_error(spark, monkeypatch):
    from mrloom.operators import sheet

    rows = spark.createDataFrame([(f"w{i} x_{i}",) for i in range(9)], "c string")
    assert len(sheet.distinct_values(rows, "c")) == 9
    monkeypatch.setattr(sheet, "VOCABULARY", 8)
    for f in (sheet.distinct_values, sheet.array_tokens):
        with pytest.raises(ValueError):
            f(rows, "c")


def test_ranks_are_exact_in_a_large_class(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "small").alias("g"), (F.col("id") * 7919 % 3001).alias("k"), F.lit("x").alias("rank"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.ranked(rows.drop("rank"), "g", [F.col("k")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("big", "small", None):
        own = sorted((r["k"], r["rank"], r["size"]) for r in got if r["g"] == g)
        assert [r[1:] for r in own] == [(i + 1, len(own)) for i in range(len(own))]
    assert len(got) == 3000
    assert ranks.ranked(rows.where("false").drop("rank"), "g", [F.col("k")]).count() == 0


def test_scanned_fields_are_all_that_is_read(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    header = '{"00080070": {"vr": "LO", "Value": ["SIEMENS"]}, "00200011": {"vr": "IS", "Value": [7]}, "00080008": {"vr": "CS", "Value": ["ORIGINAL", "M"]}, "00100010": {"vr": "PN", "Value": [{"Alphabetic": "x"}]}, "7FE00010": {"vr": "OW", "InlineBinary": "%s"}}'
    (tmp_path / "a" / "x.json").write_text(header % ("A" * 100_000))
    (tmp_path / "a" / "b" / "y.json").write_text("no header")
    (tmp_path / "a" / "b" / "z.json").write_text("{\n}")
    scanned = headers.scan_fields(spark, str(tmp_path / "a"), ["Manufacturer", "SeriesNumber", "ImageType", "EchoTime"])
    got = {r["file_path"].rsplit("/", 1)[-1]: tuple(r)[1:] for r in scanned.collect()}
    assert got == {"x.json": ("SIEMENS", "7", "ORIGINAL/M", None), "z.json": (None,) * 4}
    plan = scanned.where("SeriesNumber = 7").select("ImageType")._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "00080008" in read and "00200011" in read and "00080070" not in read and "00180081" not in read
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "part.json").write_text(header % "A" + "\nbroken\n" + header % "B")
    assert [r["SeriesNumber"] for r in headers.scan_fields(spark, str(lines), ["SeriesNumber"], lines=True).collect()] == ["7", "7"]


def test_little_endian_doubles(spark):
    import math
    import struct

    from mrloom.functions import fields

    values = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-310, -5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 123456.789, float("inf"), float("-inf")]
    rows = spark.createDataFrame([(v, bytearray(struct.pack("<d", v))) for v in values], "v double, raw binary")
    for r in rows.withColumn("got", fields.little_endian_double(F.col("raw"))).collect():
        assert r["got"] == r["v"] and math.copysign(1, r["got"]) == math.copysign(1, r["v"])
    nan = spark.createDataFrame([(bytearray(struct.pack("<d", float("nan"))),)], "raw binary")
    assert math.isnan(nan.select(fields.little_endian_double(F.col("raw"))).first()[0])


def test_differing_voxels_across_blocks(spark):
    import random

    rng = random.Random(6)
    places = [(z, y, x) for z in range(-2, 5) for y in range(6) for x in range(3)]
    a = {(i, *p): float(rng.randint(0, 30)) for i in (1, 2) for p in places if rng.random() < 0.8}
    b = {(i, *p): float(rng.randint(0, 30)) for i in (1, 3) for p in places if rng.random() < 0.8}
    frame = lambda rows: spark.createDataFrame([(*k, v) for k, v in rows.items()], "image int, z int, y int, x int, v double")
    for radius, block in ((0, 4), (1, 2), (1, 32), (2, 3)):
        want = {}
        for (i, z, y, x), v in a.items():
            near = [w for (j, p, q, r), w in b.items() if j == i and max(abs(p - z), abs(q - y), abs(r - x)) <= radius]
            want[i] = want.get(i, 0) + (min((abs(v - w) for w in near), default=float("inf")) > 2.5)
        got = {r["image"]: r["n_differing"] for r in voxels.differing(frame(a), frame(b), "image", 2.5, radius, block).collect()}
        assert got == want


def test_unusable_columns_in_two_passes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0.0, nan, "a" if i == 3 else "b" if i == 5 else None, i, inf if i else -inf) for i in range(100)]
    sheet_rows = spark.createDataFrame(rows, "one int, none string, zero double, nan double, rare string, many int, `an end` double").withColumn("few", F.when(F.col("many") < 4, F.when(F.col("many") % 2 == 0, -0.0).otherwise(0.0)).otherwise(F.lit(None))).withColumn("two", F.when(F.col("many") < 4, F.col("many") % 2 + 0.5))
    found = sheet.unusable_columns(sheet_rows)
    got = {r["column"]: (r["share"], r["n"]) for r in found.collect()}
    assert got == {"one": (1.0, 1), "none": (0.0, 0), "zero": (1.0, 1), "nan": (1.0, 1), "rare": (0.02, 2), "few": (0.04, 1), "two": (0.04, 2)}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert sheet.unusable_columns(sheet_rows.where("false")).count() == len(sheet_rows.columns)


def test_a_lacking_feature_is_filled_by_name(spark):
    rows = spark.createDataFrame([(1, None)], "k int, `Echo Time` double")
    assert sheet.filled(rows, ["Echo Time", "SAR", "ImageType_ADC"]).first().asDict() == {"k": 1, "Echo Time": -12345.0, "SAR": -12345.0, "ImageType_ADC": 0.0}


def test_orientation_sets_of_two_datasets(spark):
    headers_of = spark.createDataFrame([(0, "s", "f", 1.0, 2.0), (1, "s", "g", 1.0, 2.0), (1, "s", "h", None, 2.0), (0, "t", "i", 1.0, 1.0)], "dataset int, series string, file string, a double, b double")
    labels = spark.createDataFrame([(0, "s", "ax"), (1, "s", "sag"), (0, "t", "INVALID")], "dataset int, series string, orientation string")
    got = sheet.orientation_set(headers_of, labels, ["dataset", "series"], ["a", "b"], ["file"]).collect()
    assert sorted((r["dataset"], r["file"], r["code"]) for r in got) == [(0, "f", 0), (1, "g", 2)]


def test_sparse_flags_of_a_wide_vocabulary(spark):
    tokens = spark.range(100_000).select(F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("token")).unionByName(spark.createDataFrame([("AX",), ("X",), ("AX",), ("",), (None,)], "token string"))
    vocabulary = sheet.token_table(tokens)
    assert vocabulary.count() == 100_002 and vocabulary.agg(F.max("index")).first()[0] == 100_001
    rows = spark.createDataFrame([(1, "AX/T000007_T099999"), (2, "ax"), (3, None), (4, ""), (5, "TX T00000"), (6, "AX/T000007_T099999")], "k int, `a text` string")
    got = {r["k"]: r["flags"] for r in sheet.sparse_flags(rows, "a text", vocabulary).collect()}
    assert got == {1: [0, 8, 100_000, 100_001], 2: [], 3: [], 4: [], 5: [100_001], 6: [0, 8, 100_000, 100_001]}
    assert sheet.sparse_flags(rows, "a text", vocabulary.where("false")).count() == 6
