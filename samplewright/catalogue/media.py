"""Video variants, projections, tracks and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.catalogue.bridge import DETECTIONS_SQL, detections, rasters
from samplewright.operators import raster, report, video
from samplewright.session import table

SPEC = video.Spec(
    "street", 7, "full-factorial", 10_000, None,
    (video.Operator("speed", "pace", {"factor": [0.5, 0.75, 1.25, 2.0]}), video.Operator("grade", "look", {"tone": ["warm", "cold", "grey"]}), video.Operator("reframe", "frame", {"aspect": ["1:1", "9:16", "16:9", "4:5"]}), video.Operator("trim", "span", {"start": [0, 1, 2], "end": [5, 6]})),
)


def _flat(rows):
    return rows.select("variant_id", "ordinal", F.concat_ws(";", F.transform(F.array_sort(F.map_entries("fingerprint")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("ops"))


def _spec(strategy, most=10_000, active=None):
    return video.Spec(SPEC.id, SPEC.seed, strategy, most, active, SPEC.operators)


def video_variants_full(spark, d):
    return _flat(video.variants(spark, SPEC)).drop("variant_id")


def video_variants_paired(spark, d):
    return _flat(video.variants(spark, _spec("paired"))).drop("variant_id")


def video_variants_random(spark, d):
    return _flat(video.variants(spark, _spec("random", 40))).drop("variant_id")


def video_variants_truncated(spark, d):
    return _flat(video.variants(spark, _spec("full-factorial", 25, 4))).drop("variant_id")


def contrast_pairs(spark, d):
    pairs = video.contrast_pairs(video.variants(spark, SPEC))
    return pairs.groupBy("axis", "relation").agg(F.count("*").alias("n"))


def contrast_pairs_paired(spark, d):
    pairs = video.contrast_pairs(video.variants(spark, _spec("paired")))
    return pairs.groupBy("axis", "relation").agg(F.count("*").alias("n"))


def _words(spark, d):
    """Events of a user as timed words: half a second each, on a ten second clock."""
    at = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")) / 1000, F.lit(10000)) / 1000
    return table(spark, d, "events").select("event_id", at.alias("t0"), (at + 0.5).alias("t1"))


def project_spans(spark, d):
    a, b = video.project_span(F.col("t0"), F.col("t1"), F.lit(-0.5), F.lit(6.0))
    return _words(spark, d).select("event_id", F.round(a, 8).alias("t0"), F.round(b, 8).alias("t1"))


def project_words(spark, d):
    out = video.project_words(_words(spark, d), F.lit(2.0), F.lit(-3.0), F.lit(8.0))
    return out.select("event_id", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


_MAP = {"a": 0.0, "b": 1.0, "c": -1.0, "d": 0.5, "tx": 1.0, "ty": 0.1}
_PLACE = {"x": 0.1, "y": 0.2, "w": 0.8, "h": 0.6}


def project_boxes(spark, d):
    b = {"x_min": F.col("x_min") / 800, "y_min": F.col("y_min") / 600, "x_max": F.col("x_max") / 800, "y_max": F.col("y_max") / 600}
    out = video.project_box(b, {k: F.lit(v) for k, v in _MAP.items()}, {k: F.lit(v) for k, v in _PLACE.items()})
    return detections(spark, d).select("object_id", *[F.round(v, 6).alias(e) for e, v in out.items()])


def compose_transforms(spark, d):
    first = {"a": F.col("l_quantity") / 50, "b": F.lit(0.0), "c": F.col("l_tax"), "d": 1 - F.col("l_discount"), "tx": F.col("l_discount"), "ty": F.lit(0.25), "scale": 1 + F.col("l_tax"), "offset": F.col("l_quantity"), "semantics": F.when(F.col("l_returnflag") == "A", "edited").otherwise("preserved")}
    second = {**{k: F.lit(v) for k, v in _MAP.items()}, "scale": F.lit(0.5), "offset": F.lit(-1.0), "semantics": F.when(F.col("l_linestatus") == "F", "synthesized").otherwise("preserved"), **{k: F.lit(v) for k, v in _PLACE.items()}}
    out = video.compose(first, second)
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(key.alias("id"), *[F.round(out[k], 6).alias(k) for k in ("a", "b", "c", "d", "tx", "ty", "scale", "offset")], out["semantics"].alias("semantics"), out["w"].alias("w"))


def _observations(spark, d):
    """Event hours of a user as the frames of a track."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return table(spark, d, "events").select(F.col("user_id").alias("track_id"), hour.alias("frame"))


def track_gaps(spark, d):
    return report.track_gaps(_observations(spark, d))


def track_continuity(spark, d):
    return report.track_continuity(_observations(spark, d))


def mask_geometry(spark, d):
    return raster.mask_geometry(rasters(spark, d)).select("id", "area", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "x_min", "y_min", "x_max", "y_max")


def mask_iou(spark, d):
    masks = raster.packed_masks(rasters(spark, d))
    first = masks.groupBy("label").agg(F.min_by("mask", "id").alias("first_mask"))
    return masks.join(first, "label").select("id", F.round(raster.packed_iou(F.col("mask"), F.col("first_mask")), 6).alias("iou"))


def raster_hashes(spark, d):
    return raster.hashes(rasters(spark, d).select("id", "pixels", F.lit(8).alias("width"), F.lit(8).alias("height")))


def raster_metrics(spark, d):
    """All pixel metrics of each raster against the first of its label."""
    rows = rasters(spark, d)
    first = rows.groupBy("label").agg(F.min_by("pixels", "id").alias("source"))
    return raster.measure(rows.join(first, "label").select("id", "source", F.col("pixels").alias("produced"), F.lit(8).alias("width"), F.lit(8).alias("height")))


FUNCTIONS = [video_variants_full, video_variants_paired, video_variants_random, video_variants_truncated, contrast_pairs, contrast_pairs_paired, project_spans, project_words, project_boxes, compose_transforms, track_gaps, track_continuity, mask_geometry, mask_iou, raster_hashes, raster_metrics]
QUERIES = {f.__name__: f for f in FUNCTIONS}


def _choice_sql(o, i):
    rows = ", ".join(f"({j}, '{c}')" for j, c in enumerate(o.choices()))
    return f"c{i}(i{i}, v{i}) AS (VALUES {rows})"


_CHOICES = ", ".join(_choice_sql(o, i) for i, o in enumerate(SPEC.operators))
_SIZES = [len(o.choices()) for o in SPEC.operators]
_ORDINAL = f"((i0 * {_SIZES[1]} + i1) * {_SIZES[2]} + i2) * {_SIZES[3]} + i3"
_OPS = "'frame=' || v2 || ';look=' || v1 || ';pace=' || v0 || ';span=' || v3"
_FULL = f"WITH {_CHOICES}, v AS (SELECT CAST({_ORDINAL} AS BIGINT) AS ordinal, {_OPS} AS ops, * FROM c0, c1, c2, c3)"
_STARTS = [1 + sum(_SIZES[:i]) for i in range(4)]
_PAIRED = f"WITH {_CHOICES}, v AS (SELECT 0::BIGINT AS ordinal, '' AS ops, NULL AS axis UNION ALL " + " UNION ALL ".join(f"SELECT CAST(i{i} + {_STARTS[i]} AS BIGINT), '{o.axis}=' || v{i}, '{o.axis}' FROM c{i}" for i, o in enumerate(SPEC.operators)) + ")"
_DIFFER = " + ".join(f"CAST(a.v{i} <> b.v{i} AS INTEGER)" for i in range(4))
_AXIS = "CASE WHEN a.v0 <> b.v0 THEN 'pace' WHEN a.v1 <> b.v1 THEN 'look' WHEN a.v2 <> b.v2 THEN 'frame' ELSE 'span' END"
_WORDS = "w AS (SELECT event_id, (epoch_us(ts) / 1000.0::DOUBLE) % 10000 / 1000 AS t0, (epoch_us(ts) / 1000.0::DOUBLE) % 10000 / 1000 + 0.5::DOUBLE AS t1 FROM events)"
_OBS = "ob AS (SELECT user_id AS track_id, epoch_us(ts) // 3600000000 AS frame FROM events)"
_PX = "px AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS p, list_sum(embedding::DOUBLE[]) / 64 AS m FROM embeddings), cell AS (SELECT id, label, i - 1 AS k, p[i] > m AS lit FROM px, range(1, 65) r(i))"
_B = {"x_min": "x_min / 800", "x_max": "x_max / 800", "y_min": "y_min / 600", "y_max": "y_max / 600"}
_FIRST = {"a": "l_quantity / 50", "b": "0", "c": "l_tax", "d": "(1 - l_discount)", "tx": "l_discount", "ty": "0.25"}
SQL = {
    "video_variants_full": f"{_FULL} SELECT ordinal, ops FROM v",
    "video_variants_paired": f"{_PAIRED} SELECT ordinal, ops FROM v",
    "video_variants_truncated": f"{_FULL} SELECT ordinal, ops FROM v WHERE ordinal < 25",
    "contrast_pairs": f"{_FULL} SELECT {_AXIS} AS axis, {_AXIS} || '-invariance' AS relation, count(*) AS n FROM v a JOIN v b ON a.ordinal < b.ordinal WHERE {_DIFFER} = 1 GROUP BY ALL",
    "contrast_pairs_paired": f"{_PAIRED} SELECT b.axis AS axis, CASE WHEN a.axis IS NULL THEN 'identity-invariance' ELSE b.axis || '-invariance' END AS relation, count(*) AS n FROM v a JOIN v b ON a.ordinal < b.ordinal WHERE a.axis IS NULL OR a.axis = b.axis GROUP BY ALL",
    "project_spans": f"WITH {_WORDS} SELECT event_id, round(least(t0 * -0.5::DOUBLE + 6, t1 * -0.5::DOUBLE + 6), 8) AS t0, round(greatest(t0 * -0.5::DOUBLE + 6, t1 * -0.5::DOUBLE + 6), 8) AS t1 FROM w",
    "project_words": f"WITH {_WORDS}, p AS (SELECT event_id, greatest(0, t0 * 2 - 3) AS t0, least(8, t1 * 2 - 3) AS t1 FROM w) SELECT event_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM p WHERE t1 - t0 > 1e-6",
    "project_boxes": f"""WITH {DETECTIONS_SQL} SELECT object_id, round(0.1::DOUBLE + (1 - {_B['y_max']}) * 0.8::DOUBLE, 6) AS x_min, round(0.2::DOUBLE + ({_B['x_min']} + 0.5::DOUBLE * {_B['y_min']} + 0.1::DOUBLE) * 0.6::DOUBLE, 6) AS y_min,
  round(0.1::DOUBLE + (1 - {_B['y_min']}) * 0.8::DOUBLE, 6) AS x_max, round(0.2::DOUBLE + ({_B['x_max']} + 0.5::DOUBLE * {_B['y_max']} + 0.1::DOUBLE) * 0.6::DOUBLE, 6) AS y_max FROM det""",
    "compose_transforms": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, round(0.0::DOUBLE * {_FIRST['a']}, 6) AS a, round({_FIRST['a']}, 6) AS b, round(-{_FIRST['d']}, 6) AS c, round({_FIRST['c']} + 0.5::DOUBLE * {_FIRST['d']}, 6) AS d,
  round(-0.25::DOUBLE + 1, 6) AS tx, round({_FIRST['tx']} + 0.125::DOUBLE + 0.1::DOUBLE, 6) AS ty, round(0.5::DOUBLE * (1 + l_tax), 6) AS scale, round(0.5::DOUBLE * l_quantity - 1, 6) AS offset,
  CASE WHEN l_linestatus = 'F' THEN 'synthesized' WHEN l_returnflag = 'A' THEN 'edited' ELSE 'preserved' END AS semantics, 0.8::DOUBLE AS w FROM lineitem""",
    "track_gaps": f"WITH {_OBS}, s AS (SELECT *, lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS before FROM (SELECT DISTINCT * FROM ob)) SELECT track_id, before + 1 AS first_missing, frame - 1 AS last_missing FROM s WHERE frame - before > 1",
    "track_continuity": f"WITH {_OBS} SELECT track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT frame) AS length, max(frame) - min(frame) + 1 AS span, round(count(DISTINCT frame) / (max(frame) - min(frame) + 1), 6) AS continuity FROM ob GROUP BY track_id",
    "mask_geometry": f"WITH {_PX} SELECT id, count(*) AS area, round(avg(k % 8), 6) AS cx, round(avg(k // 8), 6) AS cy, CAST(min(k % 8) AS INTEGER) AS x_min, CAST(min(k // 8) AS INTEGER) AS y_min, CAST(max(k % 8) + 1 AS INTEGER) AS x_max, CAST(max(k // 8) + 1 AS INTEGER) AS y_max FROM cell WHERE lit GROUP BY id",
    "mask_iou": f"WITH {_PX}, f AS (SELECT label, min(id) AS first FROM px GROUP BY label), j AS (SELECT c.id, c.lit AS a, o.lit AS b FROM cell c JOIN f USING (label) JOIN cell o ON o.id = f.first AND o.k = c.k) SELECT id, round(count(*) FILTER (a AND b) / count(*) FILTER (a OR b), 6) AS iou FROM j GROUP BY id",
}


def _scenes(spark, d):
    """Synthetic 40 x 30 pictures: a graded background and one block whose place, size and colour come from an embedding."""
    import numpy as np
    import pandas as pd

    def draw(batches):
        for batch in batches:
            out = []
            for vector in batch["embedding"]:
                v = np.abs(np.asarray(vector, dtype=float))
                image = np.full((3, 30, 40), 0.45) + np.linspace(-0.04, 0.04, 30)[None, :, None]
                x, y, w, h = 5 + int(v[0] * 40) % 15, 4 + int(v[1] * 40) % 10, 8 + int(v[2] * 40) % 8, 7 + int(v[3] * 40) % 6
                image[:, y : y + h, x : x + w] = np.array([0.1, 0.85, 0.2])[:, None, None] + 0.1 * v[4:7, None, None]
                out.append(np.round(np.clip(image, 0, 1) * 255).astype(np.uint8).tobytes())
            yield pd.DataFrame({"sample_id": batch["vec_id"].astype(str), "width": 40, "height": 30, "pixels": out})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(draw, "sample_id string, width int, height int, pixels binary")


def pipeline_decisions(spark, d):
    """A whole job over synthetic pictures, by decision and reason."""
    from samplewright.plans import pipeline, recipe

    job = pipeline.run(_scenes(spark, d), recipe.load({"name": "demo", "seed": 11, "dataset": {"path": "."}, "target": {"classes": ["object"], "max_per_sample": 1}, "replacement": {"values": ["sedan", "taxi"], "candidates_per_object": 2}, "quality": {"minimum_overall": 0.5, "hard_gates": {"geometry": 0.9}}}))
    return job["decided"].select("candidate_id", "category", "overall", "decision", F.concat_ws(",", "reason_codes").alias("codes"))


QUERIES["pipeline_decisions"] = pipeline_decisions


def segment_targets(spark, d):
    """Detections of the synthetic pictures, segmented again from their boxes, with simplified outlines."""
    from samplewright.operators import backends

    scenes = _scenes(spark, d).withColumn("class_name", F.lit("object"))
    found = backends.call(scenes, backends.SALIENCY).withColumn("object_id", F.concat(F.lit("o"), "sample_id"))
    boxes = found.select("sample_id", "object_id", "x_min", "y_min", "x_max", "y_max").join(scenes.drop("class_name"), "sample_id")
    return backends.call(boxes, backends.SEGMENTER).select("object_id", "area", (F.size("polygon") / 2).cast("int").alias("points"), "error_code")


def scene_analysis(spark, d):
    """Light, contrast and background of the synthetic pictures around their object."""
    from samplewright.operators import backends

    scenes = _scenes(spark, d).withColumn("class_name", F.lit("object"))
    found = backends.call(scenes, backends.SALIENCY).withColumn("object_id", F.concat(F.lit("o"), "sample_id")).select("sample_id", "object_id", "mask")
    return backends.call(found.join(scenes, "sample_id"), backends.SCENE)


def colour_change(spark, d):
    """Rasters in three channels against themselves with two channels exchanged: the same brightness in another colour."""
    grey = F.transform("pixels", lambda v: F.least(F.abs(v) * 2, F.lit(1.0)))
    other, level = F.transform(grey, lambda v: 1 - v), F.transform(grey, lambda v: F.lit(0.5))
    none = F.transform(F.concat(grey), lambda v: F.lit(False))
    pairs = rasters(spark, d).select("id", F.concat(grey, level, other).alias("source"), F.concat(other, level, grey).alias("produced"), F.lit(8).alias("width"), F.lit(8).alias("height"), none.alias("source_mask"), none.alias("mask"))
    return raster.measure(pairs).select("id", "ssim", "changed_ratio", "mean_delta")


SQL["colour_change"] = """WITH px AS (SELECT vec_id AS id, [abs(2 * least(abs(v) * 2, 1.0::DOUBLE) - 1) * 2 / 3 FOR v IN embedding::DOUBLE[]] AS delta FROM embeddings)
SELECT id, 1.0::DOUBLE AS ssim, round(len([1 FOR x IN delta IF x > 0.1::DOUBLE]) / 64, 6) AS changed_ratio, round(list_sum(delta) / 64, 6) AS mean_delta FROM px"""
def _dct():
    """Weights of the 8 rows (or columns) in the 8 lowest of 32 cosines, over a raster in which each of them is repeated four times."""
    import math

    return [(i, k, sum(math.cos(math.pi * (2 * y + 1) * k / 64) for y in range(4 * i, 4 * i + 4)) / math.sqrt(32) / (math.sqrt(2) if k == 0 else 1)) for i in range(8) for k in range(8)]


def _drawn():
    """The draws of ``video_variants_random`` one by one."""
    from samplewright.functions.seeds import derive

    lists = {o.axis: o.choices() for o in SPEC.operators}
    for i in range(40):
        yield i, ";".join(f"{axis}={lists[axis][derive(SPEC.seed, 'variant', i, axis) % len(lists[axis])]}" for axis in sorted(lists))


_SIGNED = lambda x: f"CASE WHEN {x} > 9223372036854775807 THEN CAST({x}::HUGEINT - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST({x} AS BIGINT) END"
_BITS = lambda where, at: f"coalesce(sum(CASE WHEN {where} THEN (1::UBIGINT << (63 - {at})::UBIGINT)::HUGEINT END), 0)"
SQL["raster_hashes"] = f"""WITH px AS (SELECT vec_id AS id, embedding::DOUBLE[] AS p FROM embeddings), cell AS (SELECT id, k, p[k + 1] AS v, p FROM px, range(64) r(k)),
a AS (SELECT id, {_BITS('v > list_sum(p) / 64', 'k')} AS h FROM cell GROUP BY id),
g AS (SELECT id, r * 8 + c AS k, p[1 + CAST(floor((r + 0.5) * 8 / 9) AS BIGINT) * 8 + CAST(floor((c + 0.5) * 8 / 9) AS BIGINT)] AS l, p[1 + CAST(floor((r + 0.5) * 8 / 9) AS BIGINT) * 8 + CAST(floor((c + 1.5) * 8 / 9) AS BIGINT)] AS n FROM px, range(9) y(r), range(8) x(c)),
d AS (SELECT id, {_BITS('n > l', 'k')} AS h FROM g WHERE k < 64 GROUP BY id),
b(i, k, w) AS (VALUES {', '.join(f'({i}, {k}, {w!r}::DOUBLE)' for i, k, w in _dct())}),
f AS (SELECT id, y.k * 8 + x.k AS k, CASE WHEN y.k + x.k = 0 THEN 0 ELSE sum(v * y.w * x.w) END AS v FROM cell JOIN b y ON y.i = cell.k // 8 JOIN b x ON x.i = cell.k % 8 GROUP BY id, y.k, x.k),
m AS (SELECT *, avg(v) OVER (PARTITION BY id) AS mean FROM f), q AS (SELECT id, {_BITS('v > mean', 'k')} AS h FROM m GROUP BY id)
SELECT id, {_SIGNED('a.h')} AS ahash, {_SIGNED('d.h')} AS dhash, {_SIGNED('q.h')} AS phash FROM a JOIN d USING (id) JOIN q USING (id)"""
SQL["video_variants_random"] = "SELECT ordinal::BIGINT AS ordinal, ops FROM (VALUES " + ", ".join(f"({i}, '{ops}')" for i, ops in _drawn()) + ") v(ordinal, ops)"
QUERIES |= {"colour_change": colour_change, "segment_targets": segment_targets, "scene_analysis": scene_analysis}
