"""Distribution and progress reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from samplewright.functions import geometry as g


def histograms(objects: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """``dimension, bucket, n`` of several dimensions in one pass: each row expands map-side and is counted before the shuffle."""
    named = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket")) for d in dimensions])
    return objects.select(F.inline(named)).groupBy("dimension", "bucket").agg(F.count("*").alias("n"))


def bucketed(objects: DataFrame) -> DataFrame:
    """Adds ``size_bucket, aspect_bucket, scale_class`` to boxes with ``area, image_width, image_height``."""
    b = g.box()
    return objects.withColumns({"size_bucket": g.size_bucket(F.col("area")), "aspect_bucket": g.aspect_bucket(g.aspect(b)), "scale_class": g.scale_class(F.col("area") / (F.col("image_width") * F.col("image_height")))})


def metric_averages(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and number of the measured values of each metric."""
    return metrics.groupBy(*by, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def stage_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("stage", "status").agg(F.count("*").alias("n"))


def job_counters(runs: DataFrame) -> DataFrame:
    """Nodes of each job by outcome, and the time they took."""
    count = lambda s: F.count_if(F.col("status") == s)
    return runs.groupBy("job_id").agg(F.count("*").alias("nodes"), *[count(s).alias(s) for s in ("succeeded", "failed", "skipped", "cancelled")], F.count_if(F.col("cache_hit") == 1).alias("cache_hits"), F.sum("duration_ms").alias("duration_ms"))


def vocabulary(names: DataFrame, column: str = "category") -> DataFrame:
    """Sorted distinct names with ids from 0. The names of a label set are few; their order needs one task."""
    distinct = names.filter(F.col(column).isNotNull()).select(F.col(column).alias("category")).distinct()
    return distinct.withColumn("category_id", F.row_number().over(W.orderBy("category")) - 1)


def transitions(events: DataFrame) -> DataFrame:
    """Each candidate's state changes in order: rows ``candidate_id, seq, state`` get ``from_state``."""
    return events.withColumn("from_state", F.lag("state").over(W.partitionBy("candidate_id").orderBy("seq"))).filter("from_state is null or from_state <> state")


def track_gaps(observations: DataFrame, block: int = 100_000) -> DataFrame:
    """``track_id, first_missing, last_missing`` of frame ranges without an observation, from rows ``track_id, frame``.

    Frames are looked at in blocks, and then only the blocks' ends, so a track with a third of all rows is not sorted in one task.
    """
    seen = observations.filter("track_id is not null and frame is not null").select("track_id", "frame", F.floor(F.col("frame") / block).alias("__b")).distinct()
    inside = W.partitionBy("track_id", "__b").orderBy("frame")
    steps = seen.select("track_id", F.lag("frame").over(inside).alias("before"), "frame")
    ends = seen.groupBy("track_id", "__b").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    between = ends.select("track_id", F.lag("last").over(W.partitionBy("track_id").orderBy("__b")).alias("before"), F.col("first").alias("frame"))
    return steps.unionByName(between).filter("frame - before > 1").select("track_id", (F.col("before") + 1).alias("first_missing"), (F.col("frame") - 1).alias("last_missing"))


def track_continuity(observations: DataFrame) -> DataFrame:
    """Observed frames over the span from first to last frame."""
    seen = observations.groupBy("track_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.countDistinct("frame").alias("length"))
    span = F.col("last_frame") - F.col("first_frame") + 1
    return seen.withColumn("span", span).withColumn("continuity", F.round(F.col("length") / F.col("span"), 6))


def plan_estimate(stages: DataFrame, profile: DataFrame) -> DataFrame:
    """Planned nodes and seconds of each stage: rows of ``stage, backend_id`` times the unit estimates ``backend_id, seconds, cost``."""
    nodes = stages.groupBy("stage", "backend_id").agg(F.count("*").alias("nodes"))
    return nodes.join(F.broadcast(profile), "backend_id", "left").groupBy("stage").agg(F.sum("nodes").alias("nodes"), F.round(F.sum(F.col("nodes") * F.coalesce("seconds", F.lit(0.0))), 6).alias("seconds"), F.round(F.sum(F.col("nodes") * F.col("cost")), 6).alias("cost"))
