"""Registration of queries, and the tables that several of them start from, in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import fields as C
from ..operators import classify, forests, grouping, report, sheet, training
from ..scratch import forget, scratch, stored
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Registers a query. uses: the tables of WITH that its SQL reads, in order."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = ("WITH " + ",\n".join(WITH[u] for u in uses) + "\n" if uses else "") + sql
        return f

    return register


def coded(vols: DataFrame) -> DataFrame:
    """Volumes with their coded features; null values inside, sentinels where a model reads."""
    b = C.b_value(F.col("bvalue_raw"))
    gradient = C.direction(F.array("gx", "gy", "gz"))
    types = C.image_type_codes(F.coalesce("image_type", F.lit(S.TEXT_DEFAULTS["ImageType"])))
    sequences = C.sequence_codes("ScanningSequence", F.coalesce("scanning_sequence", F.lit(S.TEXT_DEFAULTS["ScanningSequence"])))
    contrast = C.contrast_code(F.coalesce("contrast_agent", F.lit(str(S.MISSING))))
    has_gradient = gradient.isNotNull()
    return vols.withColumns(
        {
            "b_value": b,
            "gradient": F.when(has_gradient, F.format_string("%.3f/%.3f/%.3f", "gx", "gy", "gz")),
            **types,
            **sequences,
            "Manufacturer_siemens": C.has(F.col("manufacturer"), "siemens"),
            **C.diffusion_flags(b, has_gradient),
            "likely_diffusion": C.likely_diffusion(types, b, has_gradient),
            "agent": contrast,
            "plane": C.plane(F.abs("iop_0"), F.abs("iop_5")),
            "isotropic": C.is_isotropic([F.col("pixel_spacing_0"), F.col("pixel_spacing_1")], F.col("slice_thickness")),
            "contrast": C.has_contrast(contrast),
            "perfusion": F.when(F.col("pixel_bandwidth").isNotNull(), types["ImageType_PERFUSION"]).otherwise(0),
            "is_valid": F.col("pixel_bandwidth").isNotNull(),
        }
    )


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.split_volumes(fixtures.inst(spark, sf_dir, dealt=True))


def volumes(spark: SparkSession, sf_dir: str, files: bool = False) -> DataFrame:
    """Volumes with their coded features; files: with the list of their files."""
    return classify.decided_by_series(coded((grouping.volumes if files else grouping.volume_headers)(split(spark, sf_dir))))


#: Features that the headers hold as measured.
_MEASURED = {"EchoTime": "echo_time", "FlipAngle": "flip_angle", "PixelBandwidth": "pixel_bandwidth", "RepetitionTime": "repetition_time"}


def with_features(vols: DataFrame) -> DataFrame:
    """Columns of all features, null where the header is invalid and has no record; what a valid one lacks has its default."""
    own = lambda f: F.col(f"`{_MEASURED.get(f, f)}`") if _MEASURED.get(f, f) in vols.columns else F.lit(None)
    return vols.withColumns({f: F.when(F.col("is_valid"), F.coalesce(own(f).cast("double"), F.lit(0.0 if "Sequence" in f else float(S.MISSING)))) for f in S.FEATURES})


def guessed(spark: SparkSession, sf_dir: str, forest: DataFrame | None = None, files: bool = False, vols: DataFrame | None = None) -> DataFrame:
    """Volumes with a modality: by a stored forest (nodes, with its classes' probabilities), else by a rule that SQL can follow. vols: volumes(), where they are at hand."""
    if vols is None:
        vols = volumes(spark, sf_dir, files)
    if forest is not None:
        return forests.score_by_model(with_features(vols), forest, S.FEATURES, valid=F.col("is_valid"))
    return vols.withColumn("volume_modality", F.when(F.col("is_valid"), F.expr(fixtures.GUESS)).otherwise("INVALID"))


def stored_forest(spark: SparkSession, sf_dir: str, vols: DataFrame | None = None, **how) -> tuple[DataFrame, str]:
    """A forest that is fitted on the labelled volumes and stored: its nodes, and where it lies. how: as for training.train_forest()."""
    labelled = sheet.encode_labels(with_features(guessed(spark, sf_dir, vols=vols)).where("is_valid"), S.IMAGE_TYPES, "volume_modality").select("file_name", "code", *S.FEATURES)
    path = scratch(spark, "forest")
    forests.save(training.train_forest(training.balanced(labelled, "code", "file_name", 800), S.FEATURES, **how), path)
    return forests.nodes(spark, path), path


#: Physical space of a volume: size, spacing, origin and direction of its first slice.
SPACE = ["n_rows", "n_columns", "n_slices", "pixel_spacing_0", "pixel_spacing_1", "slice_thickness", "ipp_x", "ipp_y", "ipp_z", *(f"iop_{i}" for i in range(6))]


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.roll_up(guessed(spark, sf_dir))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with modality and the space of their first volume."""
    return classify.roll_up(guessed(spark, sf_dir), SPACE)


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.repair_neighbours(placed(spark, sf_dir), SPACE)


#: What the roll-up and the repair read of a volume.
ROLLED_FROM = ["study_key", "series_number", "series_identifier", "volume_index", "volume_modality", "b_value", "gradient", "image_type", "plane", "isotropic", "contrast", "perfusion"]


def results(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, forest: DataFrame | None = None, vols: DataFrame | None = None, by_study: bool = False) -> DataFrame:
    """Volumes with the final modality of their series. The volumes are written, as both sides of the join read them; columns: those that are
    asked for, so that no others are written. vols: as for guessed(). by_study: the volumes are dealt by study, for what groups them so; the
    same exchange serves the join."""
    vols = guessed(spark, sf_dir, forest, "files" in (columns or ()), vols)
    if columns is not None:
        vols = vols.select(*dict.fromkeys([*ROLLED_FROM, *SPACE, *columns]))
    vols = stored(vols, "volumes")
    final = classify.repair_neighbours(classify.roll_up(vols, SPACE), SPACE).select("study_key", "series_number", "series_modality")
    if not by_study:
        return vols.join(final, ["study_key", "series_number"])
    of = final.groupBy("study_key").agg(F.map_from_entries(F.collect_list(F.struct("series_number", "series_modality"))).alias("_of"))
    return vols.repartition("study_key").join(of, "study_key").withColumn("series_modality", F.element_at("_of", F.col("series_number"))).drop("_of")


def results_by_forest(spark: SparkSession, sf_dir: str, columns: list[str], by_study: bool = False) -> DataFrame:
    """results() with the modality of every valid volume from a forest that is fitted on the volumes and stored. These are made and written
    once: the fit reads them several times, and the scores once more."""
    vols = volumes(spark, sf_dir)
    read = [*ROLLED_FROM, *SPACE, "file_name", "is_valid", *_MEASURED.values(), *S.FEATURES, *columns]
    vols = stored(vols.select(*(f"`{c}`" for c in dict.fromkeys(read) if c in vols.columns)), "coded")
    found = results(spark, sf_dir, columns, stored_forest(spark, sf_dir, vols)[0], vols, by_study)
    forget(vols)
    return found


_K = "PARTITION BY study_key, series_identifier"
_PLACE = "ipp_x * (iop_1 * iop_5 - iop_2 * iop_4) + ipp_y * (iop_2 * iop_3 - iop_0 * iop_5) + ipp_z * (iop_0 * iop_4 - iop_1 * iop_3)"
_FIRST = "(PARTITION BY study_key, series_number ORDER BY volume_index)"
WITH = {
    "inst": f"inst AS ({fixtures.inst_sql()})",
    "split": f"""ranked AS (SELECT *, row_number() OVER ({_K}, ipp_x, ipp_y, ipp_z ORDER BY acquisition_datetime, acquisition_number, instance_number, file_name) AS rnk, count(*) OVER ({_K}, ipp_x, ipp_y, ipp_z) AS here FROM inst),
counted AS (SELECT *, (count(*) OVER ({_K}))::int AS n_files, (sum((rnk = 1)::int) OVER ({_K}))::int AS n_positions, min(here) OVER ({_K}) AS least FROM ranked),
split AS (SELECT *, n_files % n_positions = 0 AS is_even, (CASE WHEN n_positions < n_files AND least >= n_files // n_positions THEN n_files // n_positions ELSE 1 END)::int AS n_volumes,
 (CASE WHEN NOT (n_positions < n_files AND least >= n_files // n_positions) THEN 0 WHEN rnk <= n_files // n_positions THEN rnk - 1 END)::int AS sub_volume FROM counted)""",
    "vol": f"""held AS (SELECT study_key, series_identifier, sub_volume, list(file_name ORDER BY {_PLACE}, file_name) AS files FROM split WHERE sub_volume IS NOT NULL GROUP BY ALL),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_key, series_identifier, sub_volume ORDER BY {_PLACE}, file_name) AS o FROM split WHERE sub_volume IS NOT NULL) WHERE o = 1),
vol AS (SELECT f.*, h.files, len(h.files)::int AS n_slices, (row_number() OVER (PARTITION BY f.study_key, series_number ORDER BY f.series_identifier, f.sub_volume) - 1)::int AS volume_index FROM firsts f JOIN held h ON h.study_key = f.study_key AND h.series_identifier = f.series_identifier AND h.sub_volume = f.sub_volume)""",
    "coded": """c0 AS (SELECT *, CASE WHEN bvalue_raw IS NULL OR bvalue_raw > 5000 THEN -12345.0 ELSE round_even(bvalue_raw / 10, 0) * 10 + 0.0 END::double AS b_value,
 CASE WHEN gx IS NOT NULL AND abs(1 - sqrt(gx * gx + gy * gy + gz * gz)) <= 0.01 THEN printf('%.3f/%.3f/%.3f', gx, gy, gz) END AS gradient,
 lower(coalesce(image_type, 'UnknownImageType')) AS t, lower(coalesce(scanning_sequence, 'UnknownScanningSequence')) AS s,
 CASE WHEN lower(coalesce(contrast_agent, '-12345')) IN ('none', 'no', 'no contrast', 'no_contrast', 'n', '') THEN 'None' ELSE coalesce(contrast_agent, '-12345') END AS agent FROM vol),
c1 AS (SELECT *, (contains(t, 'adc') AND NOT contains(t, 'eadc'))::int AS ImageType_ADC, contains(t, 'eadc')::int AS ImageType_EADC, contains(t, 'derived')::int AS ImageType_DERIVED, contains(t, 'diffusion')::int AS ImageType_DIFFUSION,
 contains(t, 'fa')::int AS ImageType_FA, contains(t, 'original')::int AS ImageType_ORIGINAL, contains(t, 'tracew')::int AS ImageType_TRACEW, contains(t, 'perfusion')::int AS ImageType_PERFUSION, (contains(t, 'perfusion') AND pixel_bandwidth IS NOT NULL)::int AS perfusion,
 contains(s, 'gr')::int AS ScanningSequence_GR, contains(s, 'ir')::int AS ScanningSequence_IR, contains(s, 'se')::int AS ScanningSequence_SE, coalesce(contains(lower(manufacturer), 'siemens'), false)::int AS Manufacturer_siemens,
 (b_value <> -12345)::int AS "Diffusionb-valueBool", (b_value = 0)::int AS has_b0, (b_value > 0)::int AS has_pos_b0, (gradient IS NOT NULL)::int AS HasDiffusionGradientOrientation,
 (contains(t, 'diffusion') OR contains(t, 'adc') OR contains(t, 'tracew') OR contains(t, 'fa') OR b_value > 0 OR gradient IS NOT NULL)::int AS likely_diffusion,
 pixel_bandwidth IS NOT NULL AS is_valid,
 CASE WHEN pixel_bandwidth IS NULL THEN 'INVALID' WHEN abs(iop_5) <= 0.5 THEN 'ax' WHEN abs(iop_0) <= 0.707 THEN 'sag' ELSE 'cor' END AS plane,
 abs(pixel_spacing_0 - slice_thickness) <= 1e-8 + 0.1 * abs(slice_thickness) AND abs(pixel_spacing_1 - slice_thickness) <= 1e-8 + 0.1 * abs(slice_thickness) AS own_isotropic,
 NOT contains(lower(agent), 'none') AS own_contrast FROM c0),
coded AS (SELECT *, CASE WHEN NOT is_valid THEN false WHEN first_value(is_valid) OVER _FIRST THEN first_value(own_isotropic) OVER _FIRST END AS isotropic, is_valid AND first_value(is_valid) OVER _FIRST AND first_value(own_contrast) OVER _FIRST AS contrast FROM c1)""".replace("OVER _FIRST", f"OVER {_FIRST}"),
    "guessed": f"guessed AS (SELECT *, CASE WHEN is_valid THEN {fixtures.GUESS} ELSE 'INVALID' END AS volume_modality FROM coded)",
    "rolled": """sets AS (SELECT study_key, series_number, count(*)::int AS n, list(DISTINCT replace(volume_modality, 'LOW_PROBABILITY_', '')) AS types, bool_or(b_value = -12345) AS no_b, count(DISTINCT gradient) AS directions,
 arg_min(coalesce(image_type, ''), volume_index) <> '' AS typed, arg_min(volume_modality, volume_index) AS first_type, arg_min(b_value, volume_index) AS first_b_value, arg_min(plane, volume_index) AS plane, arg_min(isotropic, volume_index) AS isotropic,
 arg_min(contrast, volume_index) AS contrast, max(perfusion) = 1 AS perf, min(series_identifier) AS series_identifier FROM guessed GROUP BY study_key, series_number),
g AS (SELECT *, replace(first_type, 'LOW_PROBABILITY_', '') AS bare, CASE WHEN NOT typed THEN 'MISSING_IMAGE_TYPE' WHEN directions >= 3 THEN 'dwig' ELSE 'tracew' END AS by_gradient FROM sets),
rolled AS (SELECT study_key, series_number, n, first_b_value, plane, isotropic, contrast, series_identifier, CASE WHEN perf THEN 'perfusion'
 WHEN n = 1 THEN CASE WHEN first_b_value > 0 AND bare NOT IN ('tracew', 'adc', 'fa', 'eadc', 'dwig') THEN by_gradient ELSE bare END
 WHEN len(types) = 1 THEN CASE WHEN NOT no_b THEN by_gradient ELSE first_type END
 WHEN list_contains(types, 'pd') AND list_contains(types, 't2w') THEN 'PDT2' WHEN list_contains(types, 'dwig') THEN by_gradient WHEN list_contains(types, 'tracew') THEN 'tracew' WHEN NOT no_b THEN by_gradient ELSE first_type END AS series_modality FROM g)""",
    "repaired": """first_vol AS (SELECT study_key, series_number, row(n_rows, n_columns, n_slices, pixel_spacing_0, pixel_spacing_1, slice_thickness, ipp_x, ipp_y, ipp_z, iop_0, iop_1, iop_2, iop_3, iop_4, iop_5) AS space FROM guessed WHERE volume_index = 0),
p AS (SELECT r.*, space, first_b_value = 0 AND series_modality NOT IN ('tracew', 'adc', 'fa', 'eadc', 'dwig') AS cand FROM rolled r JOIN first_vol USING (study_key, series_number)),
walk AS (SELECT p.study_key, p.series_number, p.cand AND (coalesce(lo.series_modality = 'tracew' AND lo.space = p.space, false) OR coalesce(hi.series_modality = 'tracew' AND hi.space = p.space, false)) AS flips
 FROM p LEFT JOIN p lo ON lo.study_key = p.study_key AND lo.series_number = p.series_number - 1 LEFT JOIN p hi ON hi.study_key = p.study_key AND hi.series_number = p.series_number + 1),
chain AS (SELECT study_key, series_number FROM walk WHERE flips UNION SELECT p.study_key, p.series_number FROM chain c JOIN p ON p.study_key = c.study_key AND p.series_number = c.series_number + 1 JOIN p lo ON lo.study_key = c.study_key AND lo.series_number = c.series_number WHERE p.cand AND p.space = lo.space),
repaired AS (SELECT p.* EXCLUDE (series_modality, cand, space), c.series_number IS NOT NULL AS is_repaired, CASE WHEN c.series_number IS NOT NULL THEN 'tracew' ELSE series_modality END AS series_modality FROM p LEFT JOIN chain c USING (study_key, series_number))""",
    "results": "results AS (SELECT g.*, r.series_modality FROM guessed g JOIN repaired r USING (study_key, series_number))",
}
WITH["nulled"] = f"""n AS (SELECT *, acquisition_number > 0 AS given FROM inst),
fresh AS (SELECT *, NOT given OR file_name = min(file_name) OVER ({_K}, given, ipp_x, ipp_y, ipp_z) AS is_new FROM n)"""
VOL = ("inst", "split", "vol")
CODED = (*VOL, "coded")
GUESSED = (*CODED, "guessed")
ROLLED = (*GUESSED, "rolled")
REPAIRED = (*ROLLED, "repaired")
RESULTS = (*REPAIRED, "results")
WITH["inst"] = "RECURSIVE " + WITH["inst"]
