"""Metric outcomes from measured numbers: value, status and reason codes, as column expressions.

Scores are "higher is better" in [0, 1]. A measurement that is null gives a null value and the status ``skipped``; it is never read as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the geometry outcome.
GEOMETRY = {"centroid_shift_max": 0.08, "area_ratio_min": 0.70, "area_ratio_max": 1.45, "aspect_ratio_delta_max": 0.30, "ground_contact_max": 0.05}


def unit(value: Column) -> Column:
    """Clip to [0, 1]; null stays null (``least`` and ``greatest`` would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def _codes(*flags: tuple[Column, str]) -> Column:
    return F.array_distinct(F.filter(F.array(*[F.when(on, F.lit(code)) for on, code in flags]), lambda c: c.isNotNull()))


def _finish(df: DataFrame, metric: str, value: Column, passed: Column, codes: Column, severity: str = "hard") -> DataFrame:
    bad = "failed" if severity == "hard" else "warned"
    return (
        df.withColumn(metric, F.round(value, 6))
        .withColumn(f"{metric}_status", F.when(F.col(metric).isNull(), "skipped").when(passed, "passed").otherwise(bad))
        .withColumn(f"{metric}__codes", F.when(F.col(f"{metric}_status").isin("passed", "skipped"), F.array().cast("array<string>")).otherwise(codes))
    )


def similarity(value: Column, tolerance: float) -> Column:
    """1 at 1 or more, falling to 0 over the tolerance."""
    return unit(1 - F.greatest(F.lit(0.0), 1 - value) / tolerance)


def presence(df: DataFrame, minimum: float = 0.60) -> DataFrame:
    """Needs ``found, coverage, expected_coverage``: the share of the replaced region that the found object covers."""
    there = F.coalesce(F.col("found"), F.lit(False)) & (F.col("coverage") > 0)
    value = F.when(there & (F.col("expected_coverage") > 0), unit(F.try_divide(F.col("coverage"), F.greatest(F.col("expected_coverage"), F.lit(1e-6))))).otherwise(0.0)
    return _finish(df, "target_presence", value, F.col("target_presence") >= minimum, _codes((F.lit(True), "OBJECT_NOT_FOUND")))


def background(df: DataFrame, ceiling: float = 0.06, threshold: float = 0.93) -> DataFrame:
    """Needs ``ssim, changed_ratio, perceptual_delta``. More change than the ceiling fails whatever the score; a low score alone is noise."""
    value = unit(0.5 * F.col("ssim") + 0.3 * (1 - F.col("changed_ratio")) + 0.2 * F.col("perceptual_delta"))
    over = F.col("changed_ratio") > ceiling
    return _finish(df, "background_preservation", value, ~over & (F.col("background_preservation") >= threshold), _codes((over, "BACKGROUND_CHANGED"), (~over, "BACKGROUND_NOISE")))


def boundary(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Needs ``seam, gradient_gap, interior_area``; an empty mask (null interior) scores 0. The hollow term is a quarter at most, so the score ends at 0.85."""
    hollow = F.when(F.col("interior_area") > 0, 0.25).otherwise(0.0)
    value = F.when(F.col("interior_area").isNull(), 0.0).otherwise(unit(0.5 * F.col("seam") + 0.3 * (1 - F.col("gradient_gap")) + 0.2 * hollow))
    return _finish(df, "mask_boundary", value, F.col("mask_boundary") >= threshold, _codes((F.lit(True), "MASK_BOUNDARY_ARTIFACT")), "warn")


def artifact(df: DataFrame, maximum: float = 0.10) -> DataFrame:
    """Needs ``floating, edge_density, text_like, component_ratio``."""
    score = unit(0.35 * F.col("floating") + 0.25 * F.col("edge_density") + 0.20 * F.col("text_like") + 0.20 * F.greatest(F.lit(0.0), 1 - F.col("component_ratio")))
    return _finish(df, "artifact_free", 1 - score, F.col("artifact_free") >= 1 - maximum, _codes((F.lit(True), "ARTIFACT_DETECTED")), "warn")


def geometry(df: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Needs ``centroid_shift, area_ratio, aspect_delta, contact_shift``; the score falls with the worst violation."""
    at = GEOMETRY | (limits or {})
    ratio = F.col("area_ratio")
    shift, aspect, ground = (F.col(c) / max(at[k], 1e-6) for c, k in (("centroid_shift", "centroid_shift_max"), ("aspect_delta", "aspect_ratio_delta_max"), ("contact_shift", "ground_contact_max")))
    area = F.when(ratio < at["area_ratio_min"], at["area_ratio_min"] / F.greatest(ratio, F.lit(1e-6))).when(ratio > at["area_ratio_max"], ratio / at["area_ratio_max"]).otherwise(1.0)
    value = F.when(ratio.isNotNull(), unit(1 - F.greatest(F.lit(0.0), F.greatest(shift, area, aspect, ground) - 1)))
    flags = [
        (F.col("centroid_shift") > at["centroid_shift_max"], "GEOMETRY_CENTROID_SHIFT"),
        (~ratio.between(at["area_ratio_min"], at["area_ratio_max"]), "GEOMETRY_SCALE_CHANGE"),
        (F.col("aspect_delta") > at["aspect_ratio_delta_max"], "GEOMETRY_ASPECT_CHANGE"),
        (F.col("contact_shift") > at["ground_contact_max"], "GEOMETRY_GROUND_CONTACT"),
    ]
    own = _codes(*flags)
    codes = F.when(F.size(own) > 1, F.concat(F.array(F.lit("GEOMETRY_VIOLATION")), own)).otherwise(own)
    return _finish(df, "geometry", value, F.size(own) == 0, codes)


def annotation(df: DataFrame, min_area: float = 64.0, threshold: float = 0.95) -> DataFrame:
    """Needs ``x_min .. y_max, image_width, image_height, mask_area, polygon_points, category_matched``; a null box scores 0."""
    outside = (F.col("x_min") < 0) | (F.col("y_min") < 0) | (F.col("x_max") > F.col("image_width")) | (F.col("y_max") > F.col("image_height"))
    empty = F.col("mask_area") <= 0
    small = ~empty & (F.col("mask_area") < min_area)
    mismatch = (F.col("polygon_points") < 3) | ~F.col("category_matched")
    loss = lambda on, by: F.when(on, by).otherwise(0.0)
    no_box = F.col("x_min").isNull()
    value = F.when(no_box, 0.0).otherwise(unit(1 - loss(outside, 0.5) - loss(empty, 1.0) - loss(small, 0.4) - loss(mismatch, 0.3)))
    codes = F.when(no_box, F.array(F.lit("ANNOTATION_EMPTY"))).otherwise(_codes((outside, "ANNOTATION_OUT_OF_BOUNDS"), (empty, "ANNOTATION_EMPTY"), (small, "ANNOTATION_TOO_SMALL"), (mismatch, "ANNOTATION_MISMATCH")))
    return _finish(df, "annotation_consistency", value, F.col("annotation_consistency") >= threshold, codes)


def structural_problems() -> Column:
    """Problems of a label row with ``x_min .. y_max, image_width, image_height, mask_width, mask_height``."""
    return _codes(
        ((F.col("x_min") < 0) | (F.col("y_min") < 0) | (F.col("x_max") > F.col("image_width")) | (F.col("y_max") > F.col("image_height")), "out_of_bounds"),
        ((F.col("x_max") <= F.col("x_min")) | (F.col("y_max") <= F.col("y_min")), "zero_area"),
        ((F.col("mask_width") != F.col("image_width")) | (F.col("mask_height") != F.col("image_height")), "mask_shape"),
    )
