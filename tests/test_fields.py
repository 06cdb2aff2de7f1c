import base64
import struct

import pytest
from mrloom import schema as S
from mrloom.functions import fields as C
from pyspark.sql import functions as F


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def texts(spark, f, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in frame.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def tags(spark, **elements):
    """One header: tag to (vr, values or bytes)."""
    held = {k[1:]: (vr, None, base64.b64encode(v).decode()) if isinstance(v, bytes) else (vr, v, None) for k, (vr, v) in elements.items()}
    return spark.createDataFrame([(held,)], f"tags {C.TAG_MAP}")


def test_numbers(spark):
    values = ["1", "1.0", "-3e2", "", "abc", None, " 7 "]
    assert texts(spark, C.is_number, values) == [True, True, True, False, False, False, True]
    assert texts(spark, C.is_integer, values) == [True, False, False, False, False, False, True]
    assert texts(spark, C.numeric_or_missing, values) == ["1", "1.0", "-3e2", "-12345", "-12345", "-12345", " 7 "]


@pytest.mark.parametrize(("raw", "want"), [(45.0, 40.0), (55.0, 60.0), (46.0, 50.0), (0.0, 0.0), (5000.0, 5000.0), (5001.0, -12345.0), (None, -12345.0), (-1.0, 0.0)])
def test_b_value_rounding(spark, raw, want):
    assert one(spark, C.b_value(F.col("x")), "x double", (raw,)) == want


def test_b_value_takes_the_first_tag_even_if_it_is_of_no_use(spark):
    b = C.b_value_of(F.col("tags"))
    assert tags(spark, t0019100C=("IS", ["1000"])).select(b).first()[0] == 1000
    assert tags(spark, t00431039=("IS", ["1000000800", "8"])).select(b).first()[0] == 800
    assert tags(spark, t00189087=("FD", []), t0019100C=("IS", ["1000"])).select(b).first()[0] == -12345
    assert tags(spark, t00189087=("FD", ["x"]), t0019100C=("IS", ["1000"])).select(b).first()[0] == -12345
    assert tags(spark, t20011003=("OB", b"600")).select(b).first()[0] == 600
    assert tags(spark, t00080070=("LO", ["x"])).select(b).first()[0] == -12345


def test_gradient(spark):
    g = C.gradient_of(F.col("tags"), binary=True)
    assert tags(spark, t00189076=("FD", ["1", "0", "0"])).select(g).first()[0] == [1, 0, 0]
    assert tags(spark, t00189076=("FD", ["1", "1", "0"])).select(g).first()[0] is None
    assert tags(spark, t00189076=("FD", ["1", "0"]), t001910E0=("DS", ["1", "0", "0"])).select(g).first()[0] is None
    assert tags(spark, t0019100E=("OB", struct.pack("<3d", 0.6, 0.8, 0))).select(g).first()[0] == [0.6, 0.8, 0]
    assert tags(spark, t20011004=("CS", ["S"])).select(g).first()[0] is None


def test_required_fields(spark):
    yes, no = F.lit(True), F.lit(False)
    text = F.col("t")
    frame = lambda v: spark.createDataFrame([(v,)], "t string")
    check = lambda f, v, there=yes: frame(v).select(C.required_value(f, there, text)).first()[0]
    assert check("EchoTime", None, no) == check("EchoTime", "") == "-12345"
    assert check("EchoTime", "x") == "INVALID_VALUE" and check("EchoTime", "3.5") == "3.5"
    assert check("SeriesNumber", "1.0") == "INVALID_VALUE" and check("SeriesNumber", "12") == "12"
    assert check("FlipAngle", "") == check("FlipAngle", None, no) == check("PixelBandwidth", "") == "INVALID_VALUE"


def test_optional_fields(spark):
    yes, no, text = F.lit(True), F.lit(False), F.col("t")
    check = lambda f, v, there=yes: spark.createDataFrame([(v,)], "t string").select(C.optional_value(f, there, text)).first()[0]
    assert check("SAR", "0.1") == "0.1" and check("SAR", "") == check("SAR", None, no) == "-12345"
    assert check("AcquisitionTime", None, no) == "000000.00" and check("AcquisitionTime", "x") == "-12345"
    assert check("ScanningSequence", None, no) == "UnknownScanningSequence"
    assert check("ContrastBolusAgent", None, no) == "-12345" and check("ContrastBolusAgent", "") == ""
    assert set(S.OPTIONAL) == {*S.NUMERIC, *S.TEXT_DEFAULTS, "AcquisitionTime", "ContrastBolusAgent"}


def test_codes(spark):
    flags = lambda t: {k: one(spark, c, "x string", (t,)) for k, c in C.image_type_codes(F.col("x")).items()}
    assert flags("DERIVED/EADC")["ImageType_ADC"] == 0 and flags("DERIVED/EADC")["ImageType_EADC"] == 1
    assert flags("x/adc")["ImageType_ADC"] == 1 and flags("SURFACE")["ImageType_FA"] == 1
    se = C.sequence_codes("ScanningSequence", F.lit(S.TEXT_DEFAULTS["ScanningSequence"]))["ScanningSequence_SE"]
    assert one(spark, se) == 1
    assert texts(spark, C.contrast_code, ["No Contrast", "n", "", "None", "Gadavist", "-12345"]) == ["None", "None", "None", "None", "Gadavist", "-12345"]
    assert texts(spark, C.has_contrast, ["None", "Gadavist", "-12345"]) == [False, True, True]
    assert texts(spark, lambda c: C.has_contrast(c, absent_is_contrast=False), ["-12345"]) == [False]


def test_planes_and_isotropy(spark):
    plane = lambda a, b: one(spark, C.plane(F.lit(a), F.lit(b)))
    assert (plane(1.0, 0.0), plane(0.0, 1.0), plane(1.0, 1.0), plane(0.707, 0.51)) == ("ax", "sag", "cor", "sag")
    iso = lambda s, t: one(spark, C.is_isotropic([F.lit(s), F.lit(1.0)], F.lit(t).cast("double")))
    assert iso(1.0, 1.05) is True and iso(1.2, 1.0) is False and iso(1.0, None) is None


def test_datetimes(spark):
    def at(a, d, t):
        frame = spark.createDataFrame([(a, d, t)], "a string, d string, t string")
        return str(frame.select(C.acquisition_datetime(F.col("a"), F.col("d"), F.col("t"))).first()[0])

    assert at("20200102030405", None, None) == "2020-01-02 03:04:05"
    assert at("20200102030405.5", "20200101", "010203") == "1900-01-01 00:00:00"
    assert at("", "20200101", "010203.5") == "2020-01-01 01:02:03"
    assert at(None, None, "010203") == "1900-01-01 01:02:03"
    assert at(None, "2020", None) == "1900-01-01 00:00:00"


def test_slugs_and_names(spark):
    assert texts(spark, C.slug, ["Héllo  Wörld!", "--a_b--", "x - y"]) == ["hello-world", "a_b", "x-y"]
    assert texts(spark, lambda c: C.slug(c, upper=True, unicode=True), ["Héllo W!"]) == ["Héllo-W"]
    assert [one(spark, C.b_suffix(F.lit(b))) for b in (0.0, 1000.0, -12345.0)] == ["_b0", "_b1000", ""]
    assert C.short_name("Pixel Spacing (x)") == "PixelSpacingx"
