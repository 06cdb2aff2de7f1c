"""Images as tables of voxels: (series, image, bvalue, z, y, x, v).

Groupings are by (series, z, y, x), with partial sums before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON, SCALE = 1e-6, 1e6
PLACE = ["series", "z", "y", "x"]


def average_by_b(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("series", "bvalue", "z", "y", "x").agg(F.avg("v").alias("v"))


def collapse_thin(voxels: DataFrame, slices: int = 10) -> DataFrame:
    """Series of fewer slices are averaged to one slice. The number of slices comes from a small grouping, not a window over all voxels."""
    depth = voxels.groupBy("series").agg((F.max("z") - F.min("z") + 1).alias("_depth"))
    flat = voxels.join(depth, "series").withColumn("z", F.when(F.col("_depth") < slices, 0).otherwise(F.col("z")))
    return flat.groupBy("series", "bvalue", "z", "y", "x").agg(F.avg("v").alias("v"))


def trace(averages: DataFrame, b: float = 1000.0) -> DataFrame:
    """The image of the b-value nearest to b, the smaller of two."""
    near = averages.groupBy("series").agg(F.min_by("bvalue", F.struct(F.abs(F.col("bvalue") - b), "bvalue")).alias("bvalue"))
    return averages.join(near, ["series", "bvalue"])


def adc_slope(voxels: DataFrame) -> DataFrame:
    """Apparent diffusion: the falling slope of the logarithm over b, at least 0."""
    slope = F.regr_slope(F.log(F.col("v") + EPSILON), F.col("bvalue"))
    return voxels.groupBy(*PLACE).agg(F.greatest(F.lit(0.0), -SCALE * slope).alias("adc"))


def adc_two_point(voxels: DataFrame) -> DataFrame:
    """The same from the smallest and the greatest b alone."""
    low, high = F.min_by("v", "bvalue"), F.max_by("v", "bvalue")
    return voxels.groupBy(*PLACE).agg(F.greatest(F.lit(0.0), SCALE * F.log((low + EPSILON) / (high + EPSILON)) / (F.max("bvalue") - F.min("bvalue"))).alias("adc"))


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two images, voxel by voxel: v and w."""
    return a.join(b.withColumnRenamed("v", "w").select(*PLACE, "w"), PLACE)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def total(images: DataFrame) -> DataFrame:
    """Sum of all images of a series."""
    return images.groupBy(*PLACE).agg(F.sum("v").alias("v"))


def min_max(images: DataFrame, key: str = "image") -> DataFrame:
    return images.groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def center_slice(images: DataFrame, low: float, high: float, key: str = "image") -> DataFrame:
    """The middle slice, its values from low to high as bytes 0 to 255."""
    depth = images.groupBy(key).agg((F.max("z") + 1).alias("_depth"))
    byte = F.round(clamp((F.col("v") - low) / (high - low) * 255, 0, 255)).cast("int")
    return images.join(depth, key).where(F.col("z") == F.floor(F.col("_depth") / 2)).select(key, "z", "y", "x", byte.alias("byte"))


def _least_differences(key: str, threshold: float, radius: int):
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        place, own = rows[["z", "y", "x"]].to_numpy(np.int64), rows["_own"].to_numpy()
        if not own.any():
            return pd.DataFrame({key: [], "n": []})
        low = place[own].min(0) - radius
        shape = place[own].max(0) + radius - low + 1
        other = place[~own] - low
        inside = ((other >= 0) & (other < shape)).all(1)
        near = np.full(shape, np.nan)
        near[tuple(other[inside].T)] = rows["v"].to_numpy()[~own][inside]
        at, v = place[own] - low, rows["v"].to_numpy()[own]
        least = np.full(len(at), np.inf)
        for step in np.ndindex(*(2 * radius + 1,) * 3):
            least = np.fmin(least, np.abs(v - near[tuple((at + step - radius).T)]))
        return pd.DataFrame({key: rows[key].iloc[:1].to_list(), "n": [int((least > threshold).sum())]})

    return run


def differing(a: DataFrame, b: DataFrame, key: str, threshold: float, radius: int = 0, block: int = 32) -> DataFrame:
    """Voxels of a that differ by more than the threshold from every voxel of b within the radius, counted per key.

    Both images are cut into blocks, b with a rim of the radius, so about (1 + 2 radius / block) cubed of its rows move; a block is an array in one task, of at most
    (block + 2 radius) cubed places, and its least differences come from shifts of it. An image has one value at a place.
    """
    axes = ("z", "y", "x")
    into = lambda c: F.floor(c / block).cast("int")
    mine = a.select(key, *axes, "v", F.lit(True).alias("_own"), *(into(F.col(c)).alias(f"_{c}") for c in axes))
    rim = b.select(key, *axes, "v", F.lit(False).alias("_own"))
    span = a.agg(*(f(into(F.col(c))).alias(f"{f.__name__}_{c}") for c in axes for f in (F.min, F.max))).first()  # the blocks that there are: none beyond them is filled
    for c in axes:
        low, high = F.greatest(into(F.col(c) - radius), F.lit(span[f"min_{c}"])), F.least(into(F.col(c) + radius), F.lit(span[f"max_{c}"]))
        rim = rim.withColumn(f"_{c}", F.explode(F.when(low <= high, F.sequence(low, high))))
    blocks = mine.unionByName(rim).groupBy(key, *(f"_{c}" for c in axes)).applyInPandas(_least_differences(key, threshold, radius), f"{key} {dict(a.dtypes)[key]}, n long")
    return blocks.groupBy(key).agg(F.sum("n").alias("n_differing"))


def zeroed(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("v", F.lit(0.0))
