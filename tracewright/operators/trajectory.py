"""Scalar series along a trajectory, resampled to a common grid and compared between groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import norm, project
from ..schemas import TRAJECTORY

SERIES = [*TRAJECTORY, "series"]
AXIS = ["pos", "step_index", "n_steps", "n_new_tokens"]


def norm_series(states: DataFrame) -> DataFrame:
    keep = [c for c in AXIS if c in states.columns]
    return states.select(*TRAJECTORY, *keep, F.lit("norm").alias("series"), norm(F.col("vec")).alias("value"))


def component_series(states: DataFrame, basis: dict, n_components: int = 1) -> DataFrame:
    """One series per principal component. `basis` comes from `fit_basis` or a stored basis document."""
    keep = [c for c in AXIS if c in states.columns]
    scores = project(F.col("vec"), basis["mean"], basis["components"][:n_components])
    return states.select(*TRAJECTORY, *keep, F.posexplode(scores).alias("k", "value")).withColumn(
        "series", F.concat(F.lit("component_"), F.col("k").cast("string"))).drop("k")


def relative_progress(axis: str = "sample") -> Column:
    """Place of a row on the 0..1 axis: by sample number, or by true step where the length is known."""
    by_sample = F.try_divide(F.col("pos").cast("double"), (F.col("n_steps") - 1).cast("double"))
    by_sample = F.coalesce(by_sample, F.lit(0.0))
    if axis == "sample":
        return by_sample
    if axis == "step":
        by_step = F.try_divide(F.col("step_index").cast("double"), (F.col("n_new_tokens") - 1).cast("double"))
        return F.when((F.col("n_new_tokens") > 1) & F.col("step_index").isNotNull(), by_step).otherwise(by_sample)
    raise ValueError(f"unknown axis {axis!r}")


def resample(series: DataFrame, n_points: int = 20, axis: str = "sample", keys: list[str] | None = None) -> DataFrame:
    """Linear interpolation at `n_points` even grid points, constant beyond the ends.

    Between two grid points only the first and the last sample matter, so each trajectory is first reduced
    (before the shuffle) to at most two samples per grid cell; the rest is arithmetic on those few.
    """
    keys = keys or SERIES
    last = n_points - 1
    x = relative_progress(axis)
    cell = F.least(F.lit(last), F.floor(F.col("x") * last)).cast("int")
    point = F.struct("x", "value")
    cells = series.withColumn("x", x).withColumn("cell", cell).groupBy(*keys, "cell").agg(
        F.min_by(point, "x").alias("head"), F.max_by(point, "x").alias("tail"))
    few = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "head", "tail"))).alias("cells"))

    def value_at(g: Column) -> Column:
        t = g.cast("double") / F.lit(float(last)) if last else F.lit(0.0)
        left = F.try_element_at(F.filter("cells", lambda c: c["cell"] < g), F.lit(-1))["tail"]
        right = F.try_element_at(F.filter("cells", lambda c: c["cell"] >= g), F.lit(1))["head"]
        slope = F.try_divide(right["value"] - left["value"], right["x"] - left["x"])
        return F.coalesce(left["value"] + (t - left["x"]) * slope, right["value"], left["value"])

    grid = F.transform(F.sequence(F.lit(0), F.lit(last)), value_at)
    return few.select(*keys, F.posexplode(grid).alias("point", "value"))


def group_curves(resampled: DataFrame, labels: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Mean and population std per series, outcome group and grid point."""
    on = on or ["qid", "sample_idx"]
    return resampled.join(labels.select(*on, "label"), on).groupBy("layer", "series", "label", "point").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))
