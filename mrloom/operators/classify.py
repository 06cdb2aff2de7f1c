"""Decisions on volumes and series: scores, the roll-up to series, and the repair of neighbours."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.fields import with_low_probability

SERIES = ["study_key", "series_number"]


def plain(modality: Column) -> Column:
    return F.regexp_replace(modality, "LOW_PROBABILITY_", "")


def missing_features(table: DataFrame, features: list[str] = S.FEATURES) -> Column:
    """Names of the features that a row lacks (its column is absent or null)."""
    gone = [F.when(F.lit(f not in table.columns) if f not in table.columns else F.col(f"`{f}`").isNull(), F.lit(f)) for f in features]
    return F.filter(F.array(*gone), lambda x: x.isNotNull())


def score(table: DataFrame, model, features: list[str], classes: dict[str, int] = S.IMAGE_TYPES, threshold: float = 0.4) -> DataFrame:
    """Code, name and probabilities of every row by a fitted model, in one pass; name carries LOW_PROBABILITY_ below the threshold."""
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    scored = model.transform(assembler.transform(table)).withColumn("_p", vector_to_array("probability"))  # once, not for each class
    names = F.create_map(*(x for name, code in classes.items() for x in (F.lit(float(code)), F.lit(name))))
    p = F.col("_p")
    name = F.coalesce(F.element_at(names, F.col("prediction")), F.lit("INVALID"))
    return scored.withColumns(
        {"GUESS_ONNX_CODE": F.col("prediction").cast("int"), "GUESS_ONNX": name, **{f"GUESS_ONNX_{n}": F.get(p, F.lit(c)) for n, c in classes.items()}, "volume_modality": with_low_probability(name, p, threshold)}
    ).drop("features", "rawPrediction", "probability", "prediction", "_p")


def by_rules(table: DataFrame, rules: list[tuple[str, Column]], default: str = "INVALID") -> DataFrame:
    """volume_modality by the first rule that holds: the surface for custom classifiers without a model."""
    out = F.lit(default)
    for name, condition in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return table.withColumn("volume_modality", out)


def by_gradient(has_image_type: Column, directions: Column) -> Column:
    """dwig from three distinct gradient directions on, else tracew; a first header without image type decides alone."""
    return F.when(~has_image_type, "MISSING_IMAGE_TYPE").when(directions >= 3, "dwig").otherwise("tracew")


def decided_by_series(vols: DataFrame) -> DataFrame:
    """Isotropy and contrast of each volume are those of its series' first volume (null and False if that one is invalid); an invalid
    volume has the plane INVALID, is not isotropic and has no contrast. vols: is_valid, plane, isotropic, contrast."""
    first = lambda c: F.first(c).over(Window.partitionBy(*SERIES).orderBy("volume_index"))
    valid = F.col("is_valid")
    return vols.withColumns(
        {
            "plane": F.when(valid, F.col("plane")).otherwise("INVALID"),
            "isotropic": F.when(~valid, False).when(first("is_valid"), first("isotropic")),
            "contrast": valid & first("is_valid") & first("contrast"),
        }
    )


def roll_up(vols: DataFrame, space: list[str] | None = None) -> DataFrame:
    """One row per series. vols: volume_modality, b_value, gradient (text or null), image_type, plane, isotropic, contrast, perfusion.
    space: columns of the first volume that come along."""
    first = lambda c: F.min_by(c, "volume_index")
    series = vols.groupBy(*SERIES).agg(
        F.count("*").cast("int").alias("n"),
        F.collect_set(plain(F.col("volume_modality"))).alias("_types"),
        F.bool_or(F.col("b_value") == S.MISSING).alias("_no_b"),
        F.size(F.collect_set("gradient")).alias("_directions"),
        first(F.col("image_type").isNotNull()).alias("_typed"),
        first(F.col("volume_modality")).alias("_first"),
        first(F.col("b_value")).alias("first_b_value"),
        first(F.col("plane")).alias("plane"),
        first(F.col("isotropic")).alias("isotropic"),
        first(F.col("contrast")).alias("contrast"),
        F.bool_or(F.col("perfusion") == 1).alias("_perfusion"),
        F.min("series_identifier").alias("series_identifier"),
        *([first(F.struct(*space)).alias("_space")] if space else []),
    )
    gradient = by_gradient(F.col("_typed"), F.col("_directions"))
    held = lambda name: F.array_contains("_types", name)
    one = F.when((F.col("first_b_value") > 0) & ~plain(F.col("_first")).isin(S.DIFFUSION_TYPES), gradient).otherwise(plain(F.col("_first")))
    many = (
        F.when(F.size("_types") == 1, F.when(~F.col("_no_b"), gradient).otherwise(F.col("_first")))
        .when(held("pd") & held("t2w"), "PDT2")
        .when(held("dwig"), gradient)
        .when(held("tracew"), "tracew")
        .when(~F.col("_no_b"), gradient)
        .otherwise(F.col("_first"))
    )
    if space:
        series = series.select("*", "_space.*").drop("_space")
    return series.withColumn("series_modality", F.when(F.col("_perfusion"), "perfusion").when(F.col("n") == 1, one).otherwise(many)).drop("_types", "_no_b", "_directions", "_typed", "_first", "_perfusion")


def same_space(a: str, b: str, columns: list[str]) -> Column:
    """Whether two rows, under these aliases, have the same size, spacing, origin and direction."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def repair_neighbours(series: DataFrame, space: list[str]) -> DataFrame:
    """Series whose first volume has b = 0 and that are of no diffusion type become tracew beside a tracew series of the same space.

    Series are walked in the order of their identifiers, and a change is seen by later steps, so it runs forward along a
    chain of neighbours. Only the runs of candidates matter: a candidate flips if a neighbour is tracew
    from the start, or if its lower neighbour flips before it, whose space is the same. That is a running
    maximum over the study, so a window does it, and no study is collected.

    The order of the walk is that of series_number here, as identifiers end in it.
    """
    w = Window.partitionBy("study_key").orderBy("series_number")
    near = lambda c, step: F.when((F.lag if step < 0 else F.lead)("series_number").over(w) == F.col("series_number") + step, (F.lag if step < 0 else F.lead)(c).over(w))
    sized = series.withColumn("_space", F.struct(*space)).withColumn("_tracew", F.col("series_modality") == "tracew")
    sized = sized.withColumn("_candidate", (F.col("first_b_value") == 0) & ~F.col("series_modality").isin(S.DIFFUSION_TYPES))
    joined = sized.withColumns(
        {
            "_below": F.coalesce(near("_tracew", -1) & near("_space", -1).eqNullSafe(F.col("_space")), F.lit(False)),
            "_above": F.coalesce(near("_tracew", 1) & near("_space", 1).eqNullSafe(F.col("_space")), F.lit(False)),
            "_linked": F.coalesce(near("_candidate", -1) & near("_space", -1).eqNullSafe(F.col("_space")), F.lit(False)),
        }
    )
    # A chain is a run of candidates, each linked to the one below; within it, all from the first seed on flip.
    chained = joined.withColumn("_chain", F.sum((~(F.col("_candidate") & F.col("_linked"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seeded = F.max((F.col("_candidate") & (F.col("_below") | F.col("_above"))).cast("int")).over(Window.partitionBy("study_key", "_chain").orderBy("series_number").rowsBetween(Window.unboundedPreceding, 0))
    flips = F.col("_candidate") & (seeded == 1)
    out = chained.withColumn("_flips", flips).withColumn("is_repaired", F.col("_flips")).withColumn("series_modality", F.when(F.col("_flips"), "tracew").otherwise(F.col("series_modality")))
    return out.select(*series.columns, "is_repaired")


def select_sequences(vols: DataFrame, modality: str, plane: str) -> DataFrame:
    return vols.where((F.col("volume_modality") == modality) & (F.col("plane") == plane))


def run_names(vols: DataFrame, sub: str, ses: str, desc: str) -> DataFrame:
    """File names that count the volumes of one subject, session, plane and modality."""
    w = Window.partitionBy(sub, ses, "plane", "volume_modality").orderBy("series_number", "volume_index")
    name = F.format_string(f"%s_%s_run-00%d_acq-%s_desc-{desc}_%s", F.col(sub), F.col(ses), F.row_number().over(w), F.col("plane"), F.col("volume_modality"))
    return vols.withColumn("name", name)


def failures(rules: list[tuple[str, Column]]) -> Column:
    """Messages of the rules that a row breaks, each once."""
    return F.array_distinct(F.filter(F.array(*(F.when(~ok, F.lit(text)) for text, ok in rules)), lambda x: x.isNotNull()))


def failure_report(found: Column) -> Column:
    """The report of a volume; empty if nothing failed."""
    head = F.format_string("Identified image type: %s-%s\nIdentified bvalue: %s\nIdentified SeriesNumber: %d\n\nFailure Messages:\n", F.col("volume_modality"), F.col("plane"), F.col("b_value").cast("long").cast("string"), F.col("series_number"))
    return F.when(F.size(found) > 0, F.concat(head, F.array_join(F.transform(found, lambda x: F.concat(F.lit("\t"), x)), "\n"))).otherwise(F.lit(""))
