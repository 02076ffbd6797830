"""Target selection, matching and neighbourhood of detected objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from samplewright.functions import geometry as g


def object_area(mask_area: Column, b: dict[str, Column]) -> Column:
    """Mask pixels if there are any, else the box's whole pixels."""
    return F.when(mask_area > 0, mask_area.cast("bigint")).otherwise(F.floor(g.area(b)))


def rejection(classes: Sequence[str], min_score: float, min_area: float) -> Column:
    """Why an object is not a target; the first failing test counts. Null if it may be one."""
    wrong = ~F.col("class_name").isin(*classes) if classes else F.lit(False)
    return F.when(F.coalesce(wrong, F.lit(True)), "class").when(F.coalesce(F.col("score") < min_score, F.lit(True)), "score").when(F.coalesce(F.col("area") < min_area, F.lit(True)), "area")


def select_targets(detections: DataFrame, classes: Sequence[str], min_score: float, min_area: float, cap: int, order: str = "score", strategy: str = "all", wanted: Sequence[str] = ()) -> DataFrame:
    """The targets of each sample with their ``ordinal`` from 0.

    Needs ``sample_id, object_id, class_name, score, area``. Strategies: all, largest, first, explicit. The rank filter limits each
    map task to ``cap`` rows a sample before the shuffle.
    """
    kept = detections.filter(rejection(classes, min_score, min_area).isNull())
    if strategy == "explicit":
        kept = kept.filter(F.col("object_id").isin(*wanted))
    by = {"largest": [F.col("area").desc()], "first": []}.get(strategy, [F.col(order).desc()])
    limit = 1 if strategy in ("largest", "first") else cap
    ranked = kept.withColumn("__r", F.row_number().over(W.partitionBy("sample_id").orderBy(*by, "object_id")))
    return ranked.filter(F.col("__r") <= limit).withColumn("ordinal", F.col("__r") - 1).drop("__r")


def drop_counters(detections: DataFrame, classes: Sequence[str], min_score: float, min_area: float, cap: int) -> DataFrame:
    """Objects of each sample left out by class, score, area and by the cap; one partial aggregation."""
    why = rejection(classes, min_score, min_area)
    counts = detections.groupBy("sample_id").agg(
        F.count("*").alias("n_objects"), *[F.count_if(why == r).alias(f"dropped_{r}") for r in ("class", "score", "area")], F.count_if(why.isNull()).alias("__kept")
    )
    return counts.withColumn("dropped_cap", F.greatest(F.col("__kept") - cap, F.lit(0)).cast("bigint")).withColumn("selected", F.least(F.col("__kept"), F.lit(cap)).cast("bigint")).drop("__kept")


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Objects of the same sample side by side, the right ones under ``o_``."""
    other = right.select("sample_id", *[F.col(c).alias(f"o_{c}") for c in right.columns if c != "sample_id"])
    return left.join(other, "sample_id")


def best_match(wanted: DataFrame, detections: DataFrame, least: float = 0.15) -> DataFrame:
    """For each wanted object the detection of its sample with the highest IoU of ``least`` or more.

    Equal IoU falls to the smallest id. A wanted object without a match stays, with ``found`` false.
    """
    box = ["object_id", *g.EDGES]
    met = _pairs(wanted.select("sample_id", *box), detections.select("sample_id", *box)).withColumn("iou", F.round(g.iou(g.box(), g.box("o_")), 9)).filter(F.col("iou") >= least)
    best = met.groupBy("sample_id", "object_id").agg(F.min(F.struct((-F.col("iou")).alias("minus"), F.col("o_object_id").alias("id"))).alias("m"))
    best = best.select("sample_id", "object_id", F.col("m.id").alias("match_id"), (-F.col("m.minus")).alias("iou"))
    return wanted.select("sample_id", "object_id").join(best, ["sample_id", "object_id"], "left").withColumn("found", F.col("match_id").isNotNull())


def neighbours(targets: DataFrame, detections: DataFrame, most: int = 8) -> DataFrame:
    """Up to ``most`` other objects of the sample, by IoU, then id."""
    box = ["object_id", *g.EDGES]
    met = _pairs(targets.select("sample_id", *box), detections.select("sample_id", *box)).filter("object_id <> o_object_id").withColumn("iou", F.round(g.iou(g.box(), g.box("o_")), 9))
    near = W.partitionBy("sample_id", "object_id").orderBy(F.col("iou").desc(), "o_object_id")
    return met.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= most).select("sample_id", "object_id", F.col("o_object_id").alias("neighbour_id"), "iou", "rank")


def occlusions(targets: DataFrame, detections: DataFrame) -> DataFrame:
    """How every other object of the sample lies to a target: adjacent, overlapping, in front of or behind it.

    From half of the smaller box on, the box that reaches lower in the image is the nearer one.
    """
    box = ["object_id", *g.EDGES]
    met = _pairs(targets.select("sample_id", *box), detections.select("sample_id", *box)).filter("object_id <> o_object_id")
    share = F.round(F.least(g.overlap_on_smaller(g.box(), g.box("o_")), F.lit(1.0)), 9)
    met = met.withColumn("overlap_fraction", share)
    relation = F.when(F.col("overlap_fraction") <= 0, "adjacent").when(F.col("overlap_fraction") < 0.5, "overlapping").when(F.col("o_y_max") > F.col("y_max"), "in_front_of").otherwise("behind")
    return met.select("sample_id", "object_id", F.col("o_object_id").alias("other_id"), relation.alias("relation"), "overlap_fraction")
