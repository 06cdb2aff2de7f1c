"""Header fields as column expressions: tests, defaults, codes and derived values.

All functions take and give columns. Nulls stand for absent values inside; the sentinels of
schema.py appear where a function's result is what a model or a report reads.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

TAG_MAP = "map<string,struct<vr:string,Value:array<string>,InlineBinary:string>>"


def number(c: Column) -> Column:
    """The text as a double; null if it is no number."""
    return F.trim(c.cast("string")).try_cast("double")


def is_number(c: Column) -> Column:
    return number(c).isNotNull()


def is_integer(c: Column) -> Column:
    """Whether the text is a whole number without a point."""
    return F.coalesce(c.cast("string").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.lit(False))


def numeric_or_missing(c: Column) -> Column:
    """The text itself if it is a number, else the sentinel."""
    return F.when(is_number(c), c.cast("string")).otherwise(F.lit(str(S.MISSING)))


# Tags


def element(tags: Column, tag: str) -> Column:
    return F.try_element_at(tags, F.lit(tag))


def value(tags: Column, tag: str, index: int = 0) -> Column:
    return F.get(element(tags, tag)["Value"], F.lit(index))


def field_or_unknown(tags: Column, field: str) -> Column:
    """The first value of a field, UNKNOWN_<field> if the header has none."""
    return F.coalesce(value(tags, S.TAGS[field]), F.lit(f"UNKNOWN_{field}"))


def _inline_text(tags: Column, tag: str) -> Column:
    return F.decode(F.unbase64(element(tags, tag)["InlineBinary"]), "UTF-8")


# Required and optional fields


def invalid(field: str, present: Column, text: Column) -> Column:
    """Whether a required field spoils its header. present: the header has the element; text: its first value."""
    empty = text.isNull() | (text == "")
    if field in ("EchoTime", "RepetitionTime"):
        return present & ~empty & ~is_number(text)
    if field == "SeriesNumber":
        return ~present | ~is_integer(text)
    if field in ("PixelBandwidth", "SliceThickness"):
        return ~present | ~is_number(text)
    if field == "PixelSpacing":
        return ~present
    return ~present | empty


def required_value(field: str, present: Column, text: Column) -> Column:
    if field in ("EchoTime", "RepetitionTime"):
        return F.when(~present | text.isNull() | (text == ""), F.lit(str(S.MISSING))).when(is_number(text), text).otherwise(F.lit("INVALID_VALUE"))
    return F.when(invalid(field, present, text), F.lit("INVALID_VALUE")).otherwise(text)


def optional_value(field: str, present: Column, text: Column) -> Column:
    if field in S.NUMERIC:
        return F.when(present, numeric_or_missing(text)).otherwise(F.lit(str(S.MISSING)))
    if field == "AcquisitionTime":
        return F.when(present, numeric_or_missing(text)).otherwise(F.lit("000000.00"))
    if field == "ContrastBolusAgent":
        return F.when(present & text.isNotNull(), text).otherwise(F.lit(str(S.MISSING)))
    if field == "SeriesDescription":
        return F.when(present, F.coalesce(text, F.lit("None"))).otherwise(F.lit(S.TEXT_DEFAULTS[field]))
    return F.coalesce(F.when(present, text), F.lit(S.TEXT_DEFAULTS[field]))


# Diffusion


def b_value(raw: Column, round_to_ten: bool = True) -> Column:
    """A raw b-value, cleaned: missing or beyond the limit is the sentinel; else rounded to tens, halves to even."""
    rounded = (F.bround(raw / 10, 0) * 10 if round_to_ten else raw) + F.lit(0.0)
    return F.when(raw.isNull() | F.isnan(raw) | (raw > S.B_VALUE_LIMIT), F.lit(float(S.MISSING))).otherwise(rounded)


def b_value_of(tags: Column, round_to_ten: bool = True) -> Column:
    """The b-value of a header: the first tag that is there decides, even if it holds nothing of use."""
    out = F.lit(float(S.MISSING))
    for tag in reversed(S.B_VALUE_TAGS):
        text = F.coalesce(value(tags, tag), _inline_text(tags, tag))
        raw = number(text)
        if tag == S.PACKED_B_VALUE_TAG:
            raw = F.pmod(raw, F.lit(S.PACKED_B_VALUE_MODULUS))
        out = F.when(F.map_contains_key(tags, tag), b_value(raw, round_to_ten)).otherwise(out)
    return out


def unit_norm(v: Column) -> Column:
    """Whether a vector's length is within 0.01 of 1."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.coalesce(F.abs(1 - length) <= 0.01, F.lit(False))


def _once(value: Column, of) -> Column:
    """of(value), the value being worked out once however often it stands there."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def little_endian_double(raw: Column) -> Column:
    """8 bytes as a double: sign, exponent and fraction of its bits, scaled by an exact power of two."""
    h = F.hex(raw)
    part = lambda bits, at, n: F.conv(F.substring(bits, at, n), 16, 10).cast("long")
    turned = lambda t: F.concat(*(F.substring(t, i, 2) for i in range(15, 0, -2)))
    return _once(h, lambda t: _once(turned(t), lambda bits: _once(F.struct(part(bits, 1, 3).alias("top"), part(bits, 4, 13).alias("fraction")), lambda p: _double(p["top"], p["fraction"]))))


def _double(top: Column, fraction: Column) -> Column:
    """The double of these bits: sign and exponent, and fraction."""
    exponent = top.bitwiseAND(2047)
    size = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-1074.0))).otherwise((fraction + (1 << 52)) * F.pow(F.lit(2.0), (exponent - 1075).cast("double")))
    size = F.when(exponent == 2047, F.when(fraction == 0, float("inf")).otherwise(float("nan"))).otherwise(size)
    return F.when(top >= 2048, -size).otherwise(size)


def three_doubles(raw: Column) -> Column:
    """24 bytes as three little-endian doubles; null otherwise."""
    doubles = lambda r: F.when(F.octet_length(r) == 24, F.transform(F.array(*(F.substring(r, at, 8) for at in (1, 9, 17))), little_endian_double))
    return _once(raw, doubles)


def direction(v: Column) -> Column:
    """The vector if it has three numbers and length 1, else null."""
    return F.when((F.size(v) == 3) & F.forall(v, lambda x: x.isNotNull()) & unit_norm(v), v)


def gradient_of(tags: Column, binary: bool = False) -> Column:
    """The gradient direction of a header: the first tag that is there decides. binary: also decode 24-byte values."""
    out = F.lit(None).cast("array<double>")
    for tag in reversed(S.GRADIENT_TAGS):
        numbers = F.transform(element(tags, tag)["Value"], lambda x: x.try_cast("double"))
        if binary and tag == "0019100E":
            numbers = F.coalesce(numbers, three_doubles(F.try_to_binary(element(tags, tag)["InlineBinary"], F.lit("base64"))))
        out = F.when(F.map_contains_key(tags, tag), numbers).otherwise(out)
    return _once(out, direction)


# Codes


def has(text: Column, part: str) -> Column:
    return F.coalesce(F.lower(text).contains(part.lower()), F.lit(False)).cast("int")


def image_type_codes(text: Column) -> dict[str, Column]:
    """Flags of the defaulted image type; an eADC image is no ADC image."""
    eadc = has(text, "eadc")
    return {
        "ImageType_ADC": F.when(eadc == 1, 0).otherwise(has(text, "adc")),
        "ImageType_EADC": eadc,
        **{f"ImageType_{p}": has(text, p) for p in ("DERIVED", "DIFFUSION", "FA", "ORIGINAL", "TRACEW", "PERFUSION")},
    }


def sequence_codes(field: str, text: Column) -> dict[str, Column]:
    """Flags of the defaulted text; a missing ScanningSequence reads Unknown..., which holds 'se'."""
    return {f"{field}_{p}": has(text, p) for p in {"ScanningSequence": ("GR", "IR", "SE"), "SequenceVariant": ("MP", "SP")}[field]}


def contrast_code(text: Column) -> Column:
    return F.when(F.lower(text).isin(S.NO_CONTRAST), F.lit("None")).otherwise(text)


def diffusion_flags(b: Column, has_gradient: Column) -> dict[str, Column]:
    return {
        "Diffusionb-valueBool": (b != S.MISSING).cast("int"),
        "has_b0": (b == 0).cast("int"),
        "has_pos_b0": (b > 0).cast("int"),
        "HasDiffusionGradientOrientation": has_gradient.cast("int"),
    }


def likely_diffusion(codes: dict[str, Column], b: Column, has_gradient: Column) -> Column:
    types = [codes[f"ImageType_{p}"] == 1 for p in ("DIFFUSION", "ADC", "EADC", "TRACEW", "FA")]
    out = (b > 0) | has_gradient
    for t in types:
        out = out | t
    return out.cast("int")


# Arrays and names


def absolute_values(v: Column) -> Column:
    """Numbers of an array, or of a text parted by '/', without their signs."""
    return F.transform(v, lambda x: F.abs(x.cast("double")))


def short_name(name: str) -> str:
    return "".join(ch for ch in name if ch not in " ()")


def index_columns(name: str, v: Column, n: int) -> dict[str, Column]:
    return {f"{short_name(name)}_{i}": F.get(absolute_values(v), F.lit(i)) for i in range(n)}


def min_max_columns(name: str, v: Column) -> dict[str, Column]:
    numbers = F.transform(v, lambda x: x.cast("double"))
    return {f"{short_name(name)}Min": F.array_min(numbers), f"{short_name(name)}Max": F.array_max(numbers)}


@F.pandas_udf(T.StringType())
def _ascii(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def slug(text: Column, upper: bool = False, unicode: bool = False, plain: bool = False) -> Column:
    """A name for files: letters, digits, underscores and single dashes. plain: the text is known to be ASCII."""
    out = text if plain else _composed(text) if unicode else _ascii(text)
    out = out if upper else F.lower(out)
    out = F.regexp_replace(out, r"(?U)[^\w\s-]" if unicode else r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(out, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def b_suffix(b: Column) -> Column:
    """_b<value> for volumes that have a b-value, else nothing."""
    return F.when(b >= 0, F.concat(F.lit("_b"), b.cast("long").cast("string"))).otherwise(F.lit(""))


def acquisition_datetime(at: Column, date: Column, time: Column) -> Column:
    """The instant by which files are sorted. A date-time that is there decides alone: if it does not parse, the default stands."""
    default = F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")
    padded = F.concat(F.rpad(F.coalesce(date, F.lit("19000101")), 8, "0"), F.rpad(F.coalesce(time, F.lit("000000")), 6, "0"))
    parse = lambda c: F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return F.coalesce(F.when(F.length(at) > 0, parse(at)).otherwise(parse(padded)), default)


# Decisions on a record


def plane(iop_0: Column, iop_5: Column) -> Column:
    """Acquisition plane from the absolute direction cosines."""
    return F.when(iop_5 <= 0.5, "ax").when(iop_0 <= 0.707, "sag").otherwise("cor")


def is_isotropic(spacing: list[Column], thickness: Column) -> Column:
    """Whether every spacing is within a tenth of the slice thickness; null if one is missing."""
    out = F.lit(True)
    for s in spacing:
        out = out & (F.abs(s - thickness) <= 1e-8 + 0.1 * F.abs(thickness))
    return out


def has_contrast(code: Column, absent_is_contrast: bool = True) -> Column:
    """Whether an agent was given, from the coded agent. An absent tag was defaulted to the sentinel, which is no 'none'."""
    out = ~F.lower(code).contains("none")
    return out if absent_is_contrast else out & (code != str(S.MISSING))


def contrast_agent(code: Column, contrast: Column | None = None) -> Column:
    """The agent where there is contrast (by default as the code itself says)."""
    return F.when(has_contrast(code) if contrast is None else contrast, code).otherwise(F.lit("None"))


def with_low_probability(name: Column, probabilities: Column, threshold: float = 0.4) -> Column:
    return F.when(F.array_max(probabilities) < threshold, F.concat(F.lit("LOW_PROBABILITY_"), name)).otherwise(name)
