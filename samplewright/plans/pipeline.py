"""The whole job as lazily built DataFrames: detect, select, segment, analyse the scene, plan, generate, refine, verify, measure, decide, rebuild.

Writing an export is a command of its own (:mod:`samplewright.cli`), since it needs reviews and a place.

Pixels stay in the rows of their stage and cross a shuffle only where a sample meets its targets. A generation that cannot be
repeated belongs behind :class:`samplewright.operators.backends.Ledger`; its results are stored before anything reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import geometry as g
from samplewright.functions import identity, seeds
from samplewright.operators import annotations, backends, gates, outcomes, raster, select
from samplewright.plans.recipe import Recipe
from samplewright.session import settle, ship

#: Coverage above which a mask is no object, and the IoU from which a re-detection is the replaced object.
MOST_COVERAGE, LEAST_IOU = 0.98, 0.15


def detect(images: DataFrame, recipe: Recipe, backend: backends.Backend | None = None) -> DataFrame:
    """Detections of images ``sample_id, width, height, pixels[, class_name]``, one for each part that stands out, with content-derived object ids.

    The built-in detector is asked for the recipe's target classes. Empty masks and masks of nearly the whole image are no objects.
    """
    found = backends.call(images.select(*[c for c in ("sample_id", "width", "height", "pixels", "class_name") if c in images.columns]), backend or backends.detector(recipe.target.classes or ("object",)))
    asset = F.sha2(F.col("sample_id"), 256)
    return found.withColumn("object_id", identity.object_id(asset, F.lit(0), F.col("class_name"), g.box(), F.col("score")))


def segment(targets: DataFrame, images: DataFrame) -> DataFrame:
    """Targets with the segmenter's ``mask``, ``area`` and ``polygon`` in place of the detector's; ``error_code`` says why one has no usable mask."""
    found = backends.call(targets.drop("mask", "area").join(images, "sample_id"), backends.SEGMENTER)
    return targets.drop("mask", "area").join(found, ["sample_id", "object_id"])


def analyse(targets: DataFrame, images: DataFrame) -> DataFrame:
    """Targets with light, contrast and background of their scene."""
    scenes = backends.call(targets.select("sample_id", "object_id", "mask").join(images, "sample_id"), backends.SCENE)
    return targets.join(scenes, ["sample_id", "object_id"])


def plan(targets: DataFrame, values: Sequence[str], recipe: Recipe) -> DataFrame:
    """One row per candidate: the target's categories in turn, each with its own key, prompt and seed path.

    The prompt ends with the background of the scene, unless the recipe names its place by ``{scene}``.
    """
    n = recipe.replacement.candidates_per_object
    keys = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(values[i % len(values)]).alias("category"), F.lit(f"candidate-{i}").alias("candidate_key")) for i in range(n)])
    rows = targets.select("*", F.inline(keys))
    text = recipe.replacement.prompt
    text = F.replace(F.lit(text if "{scene}" in text else f"{text}, {{scene}}"), F.lit("{scene}"), F.col("background")) if "background" in targets.columns else F.lit(text)
    for slot, value in (("{value}", F.col("category")), ("{category}", F.col("category")), ("{description}", F.lit(recipe.replacement.description or "") if recipe.replacement.strategy == "description" else F.col("category")), ("{class}", F.col("class_name"))):
        text = F.replace(text, F.lit(slot), value)
    prompt = F.concat(text, F.lit(recipe.preserve.request))
    rows = rows.withColumn("candidate_id", identity.candidate_id(F.col("sample_id"), F.col("object_id"), F.col("candidate_key")))
    return rows.withColumn("prompt", prompt).withColumn("seed", seeds.derive_column(recipe.seed, F.col("sample_id"), F.col("object_id"), F.col("candidate_key")))


_MEASURED = "candidate_id string, sample_id string, object_id string, category string, width int, height int, found boolean, coverage double, expected_coverage double, semantic_match double, redetect_iou double, x_min double, y_min double, x_max double, y_max double, mask_area double, polygon_points int, polygon array<double>, mask binary, category_matched boolean, pixels binary, "


def _evaluate(batch: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for (h, w), rows in batch.groupby(["height", "width"]):
        rows = rows.reset_index(drop=True)
        h, w = int(h), int(w)
        source, made = (backends.stack(rows, c, h, w) for c in ("source_pixels", "pixels"))
        before = backends.masks(rows, "mask", h, w)
        refined = backends.refine(source, made, before)
        packed = backends.pack(refined)
        after = backends.redetect(backends.stack(pd.DataFrame({"pixels": packed}), "pixels", h, w), before)
        a, b = raster.shape_of(before), raster.shape_of(after)
        side = lambda lo, hi: np.maximum(np.minimum(a[hi], b[hi]) - np.maximum(a[lo], b[lo]), 0)  # noqa: B023, E731
        shared = side("x_min", "x_max") * side("y_min", "y_max")
        size = lambda s: (s["x_max"] - s["x_min"]) * (s["y_max"] - s["y_min"])
        union = size(a) + size(b) - shared
        iou = np.where(union > 0, shared / np.maximum(union, 1), 0.0)
        found = (b["area"] > 0) & (iou >= LEAST_IOU)
        after &= found[:, None, None]
        grey = lambda x: x.mean(1)
        measures = {**raster.background(source, refined, before), **raster.boundary(grey(refined), after), **raster.artifacts(grey(refined), after), **raster.movement(before, after)}
        s = raster.shape_of(after)
        rings = [raster.simplify(raster.outline(m)).ravel().astype(float).tolist() for m in after]
        out = {"candidate_id": rows["candidate_id"], "sample_id": rows["sample_id"], "object_id": rows["object_id"], "category": rows["category"], "width": w, "height": h, "found": found, "coverage": after.mean((-2, -1)), "expected_coverage": before.mean((-2, -1)),
               "semantic_match": np.round(backends.semantic(refined, after, rows["category"].tolist()), 6), "redetect_iou": np.round(iou, 6), **{e: np.where(found, s[e], np.nan) for e in g.EDGES}, "mask_area": s["area"].astype(float), "polygon_points": [len(r) // 2 for r in rings], "polygon": rings, "mask": backends.pack_masks(after), "category_matched": found, "pixels": packed}
        parts.append(pd.DataFrame({**out, **{m: np.round(measures[m], 6) for m in raster.MEASURES if m in measures}}))
    return pd.concat(parts) if parts else batch


EVALUATOR = backends.Backend("builtin_metrics", ("quality.semantic_match.v1",), _evaluate, _MEASURED + ", ".join(f"{m} double" for m in raster.MEASURES if m not in ("mask_iou", "coverage")))


def run(images: DataFrame, recipe: Recipe) -> dict[str, DataFrame]:
    """Relations of a job over images ``sample_id, width, height, pixels``: detections, targets, segments, candidates, measured, decided, labels.

    A target whose mask is refused stands in ``segments`` with its ``error_code`` and has no candidates.
    """
    if not recipe.replacement.choices:
        raise ValueError("replacement.values names no category")
    images = settle(images.select("sample_id", F.col("width").cast("int"), F.col("height").cast("int"), "pixels"), "job-images")
    detections = settle(detect(images, recipe), "job-detections")
    whole = images.select("sample_id", (F.col("width") * F.col("height")).alias("all"))
    usable = detections.join(whole, "sample_id").filter(F.col("area") <= MOST_COVERAGE * F.col("all")).drop("all")
    t = recipe.target
    targets = select.select_targets(usable, t.classes, t.min_score, t.min_area_px, t.max_per_sample, t.order_by, t.strategy, t.object_ids)
    segments = settle(segment(targets.drop("ordinal"), images), "job-segments")
    planned = analyse(segments.filter("error_code is null").drop("error_code"), images)
    candidates = settle(plan(planned, recipe.replacement.choices, recipe), "job-candidates")
    requests = candidates.join(images, "sample_id")
    made = settle(backends.call(requests, backends.generator(_schema(requests, "pixels"))), "job-generated")
    measured = settle(backends.call(made, EVALUATOR), "job-measured")
    numbers = [c for c, kind in measured.dtypes if kind == "double"]
    measured = measured.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})
    q = recipe.quality
    wide = measured.drop("pixels", "mask", "polygon").withColumns({"image_width": F.col("width"), "image_height": F.col("height")})
    for outcome in (lambda d: outcomes.presence(d, q.minimum_target_presence), lambda d: outcomes.background(d, q.background_change_ceiling), outcomes.boundary, lambda d: outcomes.artifact(d, q.maximum_artifact_score), lambda d: outcomes.geometry(d, recipe.preserve.limits), lambda d: outcomes.annotation(d, 4.0)):
        wide = outcome(wide)
    job = {"images": images, "detections": detections, "targets": targets, "segments": segments, "candidates": candidates, "measured": measured, "decided": gates.decide(wide, recipe.policy())}
    return job | {"labels": labels(job)}


def _schema(df: DataFrame, without: str) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes if n != without)


def hashes(job: dict[str, DataFrame], algorithm: str) -> tuple[DataFrame, DataFrame]:
    """Perceptual hashes for duplicate control: ``candidate_id, ord, hash`` of the produced images and ``item, hash`` of their sources."""
    kernel = lambda rows, h, w: raster.perceptual_hashes(backends.stack(rows, "pixels", h, w).mean(1))

    def of(images: DataFrame, keys: list[str]) -> DataFrame:
        ship(images.sparkSession)
        schema = ", ".join(f"{k} string" for k in keys) + ", ahash bigint, dhash bigint, phash bigint"
        return images.select(*keys, "width", "height", "pixels").mapInPandas(raster.by_shape(kernel, keys), schema).select(*keys, F.col(algorithm).alias("hash"))

    # In order of the samples, then of the candidates.
    made = of(job["measured"], ["sample_id", "candidate_id"]).select("candidate_id", F.concat_ws("/", "sample_id", "candidate_id").alias("ord"), "hash")
    return made, of(job["images"], ["sample_id"]).withColumnRenamed("sample_id", "item")


def labels(job: dict[str, DataFrame], decisions: Sequence[str] = ("accepted",), source: DataFrame | None = None) -> DataFrame:
    """Labels of the accepted candidates, or those of the named decisions: inherited objects and the regenerated target.

    What is inherited are the labels of the dataset, ``source``; a dataset without any inherits the detections.
    """
    d, c = job["detections"], job["decided"].filter(F.col("decision").isin(*decisions))
    if source is None:
        source = d.select(F.col("sample_id").alias("image"), "object_id", F.col("class_name").alias("category"), *g.EDGES, F.col("area").cast("double").alias("area"), F.lit(0).alias("iscrowd"), F.lit(None).cast("array<double>").alias("polygon"))
    replaced = d.select("sample_id", "object_id", *[F.col(e).alias(f"r_{e}") for e in g.EDGES])
    # The outline and the mask stay with the measurements; a label that lies whole in the mask is covered.
    c = c.join(job["measured"].select("candidate_id", "polygon", "mask"), "candidate_id")
    made = c.join(replaced, ["sample_id", "object_id"]).select("mask", "width", "height", F.col("candidate_id").alias("image"), F.col("sample_id").alias("source_image"), F.col("candidate_id").alias("object_id"), "category", *g.EDGES, F.col("mask_area").alias("area"), F.lit(0).alias("iscrowd"), "polygon", "found", *[f"r_{e}" for e in g.EDGES])
    return annotations.rebuild(source, made, covered=raster.covered("n_mask", "n_width", "n_height", *g.EDGES))
