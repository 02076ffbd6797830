"""Label vocabularies and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.catalogue.bridge import DETECTIONS_SQL, detections
from samplewright.functions import geometry as g
from samplewright.operators import annotations, outcomes
from samplewright.session import table

WITH = f"WITH {DETECTIONS_SQL}"


def _labels(spark, d):
    """Detections as labels of images, with part types as categories."""
    types = table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_type").alias("category"))
    det = detections(spark, d).withColumn("image", F.format_string("img_%08d.png", "sample_id"))
    return det.join(types, "part_key").withColumns({"iscrowd": F.lit(0), "polygon": F.lit(None).cast("array<double>"), "area": F.col("area").cast("double")})


def category_vocabulary(spark, d):
    return annotations.vocabulary(_labels(spark, d))


def category_vocabulary_extended(spark, d):
    labels = _labels(spark, d)
    declared = labels.filter("category < 'M'").select("category").distinct()
    declared = annotations.vocabulary(declared).withColumn("category_id", F.col("category_id") * 2)
    return annotations.vocabulary(labels, declared)


def category_rebase(spark, d):
    labels = _labels(spark, d)
    return annotations.rebase(labels, annotations.vocabulary(labels)).select("object_id", "category_id")


def coco_annotations(spark, d):
    labels = _labels(spark, d)
    rows = annotations.coco_annotations(labels, annotations.vocabulary(labels))
    return rows.select("id", "image_id", "category_id", F.concat_ws(",", F.transform("bbox", lambda v: v.cast("bigint").cast("string"))).alias("bbox"), F.concat_ws(",", F.transform(F.element_at("segmentation", 1), lambda v: v.cast("bigint").cast("string"))).alias("ring"), "area")


def coco_round_trip(spark, d):
    """Labels packed into one document per image and read again."""
    labels = _labels(spark, d)
    words = annotations.vocabulary(labels)
    rows = annotations.rebase(labels, words)
    b = g.box()
    entry = F.struct(F.col("number").cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("image_id"), "category_id", F.array(b["x_min"], b["y_min"], g.width(b), g.height(b)).alias("bbox"), "area", "iscrowd", F.lit(None).cast("array<array<double>>").alias("segmentation"))
    numbered = rows.withColumn("number", F.xxhash64("object_id"))
    packed = numbered.groupBy("image").agg(F.collect_list(entry).alias("annotations"), F.collect_set(F.struct(F.col("category_id").alias("id"), F.col("category").alias("name"))).alias("categories"), F.first("image_width").cast("int").alias("w"), F.first("image_height").cast("int").alias("h"))
    documents = packed.select(F.array(F.struct(F.lit(1).cast("bigint").alias("id"), F.col("image").alias("file_name"), F.col("w").alias("width"), F.col("h").alias("height"))).alias("images"), "annotations", "categories")
    return annotations.from_coco(documents).groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"), F.sum("x_max").alias("x_max"))


def yolo_lines(spark, d):
    labels = _labels(spark, d)
    rows = annotations.rebase(labels, annotations.vocabulary(labels))
    return rows.select("object_id", annotations.yolo_line(F.col("category_id"), F.col("image_width"), F.col("image_height")).alias("line"))


def annotation_structural_check(spark, d):
    rows = detections(spark, d).withColumns({"mask_width": F.when(F.col("class_name") == "R", F.lit(640.0)).otherwise(F.col("image_width")), "mask_height": F.col("image_height")})
    return rows.select("object_id", F.concat_ws(",", outcomes.structural_problems()).alias("problems")).filter("problems <> ''")


def annotation_consistency(spark, d):
    rows = detections(spark, d).withColumns({"mask_area": F.when(F.col("score") < 0.65, 0.0).otherwise(F.col("area").cast("double")), "polygon_points": F.when(F.col("class_name") == "N", 2).otherwise(4), "category_matched": F.col("score") > 0.7})
    rows = rows.withColumn("x_min", F.when(F.col("sample_id") % 11 != 0, F.col("x_min")))
    out = outcomes.annotation(rows, 1000.0)
    return out.select("object_id", "annotation_consistency", F.col("annotation_consistency_status").alias("status"), F.concat_ws(",", "annotation_consistency__codes").alias("codes"))


def annotation_rebuild(spark, d):
    source = _labels(spark, d).select("image", "object_id", "category", *g.EDGES, "area", "iscrowd", "polygon", "class_name", "score")
    target = source.filter("class_name = 'A' and score >= 0.9")
    produced = target.select(F.concat("image", F.lit("#"), "object_id").alias("image"), F.col("image").alias("source_image"), F.concat(F.lit("new-"), "object_id").alias("object_id"), F.lit("sedan").alias("category"),
        (F.col("x_min") - 2).alias("x_min"), (F.col("y_min") - 2).alias("y_min"), (F.col("x_max") + 2).alias("x_max"), (F.col("y_max") + 2).alias("y_max"), "area", "iscrowd", "polygon", (F.col("score") < 0.99).alias("found"), *[F.col(e).alias(f"r_{e}") for e in g.EDGES])
    return annotations.rebuild(source.drop("class_name", "score"), produced).groupBy("image").agg(F.count("*").alias("labels"), F.count_if(F.col("origin") == "inherited").alias("inherited"))


_LABELS = f"{WITH}, lab AS (SELECT det.*, format('img_{{:08d}}.png', sample_id) AS image, p_type AS category FROM det JOIN part ON p_partkey = part_key), voc AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS category_id FROM (SELECT DISTINCT category FROM lab))"
_OUT = "x_min < 0 OR y_min < 0 OR x_max > image_width OR y_max > image_height"
_CON = f"{WITH}, r AS (SELECT * REPLACE (CASE WHEN sample_id % 11 <> 0 THEN x_min END AS x_min), CASE WHEN score < 0.65 THEN 0 ELSE area END AS mask_area, CASE WHEN class_name = 'N' THEN 2 ELSE 4 END AS points, score > 0.7 AS matched FROM det), f AS (SELECT *, x_min IS NULL AS nobox, coalesce({_OUT}, false) AS outside, mask_area <= 0 AS empty, mask_area > 0 AND mask_area < 1000 AS small, points < 3 OR NOT matched AS mis FROM r), v AS (SELECT *, CASE WHEN nobox THEN 0.0::DOUBLE ELSE round(greatest(1 - CASE WHEN outside THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN empty THEN 1.0::DOUBLE ELSE 0 END - CASE WHEN small THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN mis THEN 0.3::DOUBLE ELSE 0 END, 0), 6) END AS annotation_consistency FROM f)"
FUNCTIONS = [category_vocabulary, category_vocabulary_extended, category_rebase, coco_annotations, coco_round_trip, yolo_lines, annotation_structural_check, annotation_consistency, annotation_rebuild]
QUERIES = {f.__name__: f for f in FUNCTIONS}
_I = lambda e: f"CAST(CAST({e} AS BIGINT) AS VARCHAR)"
_U = lambda e, s: f"least(greatest({e} / {s}, 0), 1)"
SQL = {
    "category_vocabulary": f"{_LABELS} SELECT category, category_id FROM voc",
    "category_vocabulary_extended": f"""{_LABELS}, dec AS (SELECT category, CAST((row_number() OVER (ORDER BY category) - 1) * 2 AS INTEGER) AS category_id FROM (SELECT DISTINCT category FROM lab WHERE category < 'M'))
SELECT * FROM dec UNION ALL SELECT category, CAST((SELECT max(category_id) FROM dec) + row_number() OVER (ORDER BY category) AS INTEGER) FROM (SELECT DISTINCT category FROM lab WHERE category NOT IN (SELECT category FROM dec))""",
    "category_rebase": f"{_LABELS} SELECT object_id, category_id FROM lab JOIN voc USING (category)",
    "coco_annotations": f"""{_LABELS}, n AS (SELECT *, row_number() OVER (ORDER BY image, object_id) AS id, dense_rank() OVER (ORDER BY image) AS image_id FROM lab)
SELECT id, image_id, category_id, concat_ws(',', {_I('x_min')}, {_I('y_min')}, {_I('x_max - x_min')}, {_I('y_max - y_min')}) AS bbox,
  concat_ws(',', {_I('x_min')}, {_I('y_min')}, {_I('x_max')}, {_I('y_min')}, {_I('x_max')}, {_I('y_max')}, {_I('x_min')}, {_I('y_max')}) AS ring, CAST(area AS DOUBLE) AS area FROM n JOIN voc USING (category)""",
    "coco_round_trip": f"{_LABELS} SELECT category, count(*) AS n, CAST(sum(area) AS DOUBLE) AS area, sum(x_max) AS x_max FROM lab GROUP BY category",
    "yolo_lines": f"""{_LABELS}, u AS (SELECT object_id, category_id, {_U('x_min', 800)} AS a, {_U('y_min', 600)} AS b, {_U('x_max', 800)} AS c, {_U('y_max', 600)} AS d FROM lab JOIN voc USING (category))
SELECT object_id, printf('%d %.6f %.6f %.6f %.6f', category_id, (a + c) / 2, (b + d) / 2, c - a, d - b) AS line FROM u""",
    "annotation_structural_check": f"{WITH}, p AS (SELECT object_id, concat_ws(',', CASE WHEN {_OUT} THEN 'out_of_bounds' END, CASE WHEN x_max <= x_min OR y_max <= y_min THEN 'zero_area' END, CASE WHEN class_name = 'R' THEN 'mask_shape' END) AS problems FROM det) SELECT * FROM p WHERE problems <> ''",
    "annotation_consistency": f"""{_CON} SELECT object_id, annotation_consistency, CASE WHEN annotation_consistency >= 0.95 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN annotation_consistency >= 0.95 THEN '' WHEN nobox THEN 'ANNOTATION_EMPTY' ELSE
  concat_ws(',', CASE WHEN outside THEN 'ANNOTATION_OUT_OF_BOUNDS' END, CASE WHEN empty THEN 'ANNOTATION_EMPTY' END, CASE WHEN small THEN 'ANNOTATION_TOO_SMALL' END, CASE WHEN mis THEN 'ANNOTATION_MISMATCH' END) END AS codes FROM v""",
    "annotation_rebuild": f"""{_LABELS}, t AS (SELECT image || '#' || object_id AS new_image, image, x_min AS a, y_min AS b, x_max AS c, y_max AS d FROM lab WHERE class_name = 'A' AND score >= 0.9 AND score < 0.99),
i AS (SELECT new_image FROM t JOIN lab USING (image) WHERE NOT (x_min >= a - 2 AND y_min >= b - 2 AND x_max <= c + 2 AND y_max <= d + 2) AND
  greatest(least(x_max, c) - greatest(x_min, a), 0) * greatest(least(y_max, d) - greatest(y_min, b), 0) / ((x_max - x_min) * (y_max - y_min) + (c - a) * (d - b) - greatest(least(x_max, c) - greatest(x_min, a), 0) * greatest(least(y_max, d) - greatest(y_min, b), 0)) < 0.5),
al AS (SELECT new_image, 1 AS inh FROM i UNION ALL SELECT new_image, 0 FROM t) SELECT new_image AS image, count(*) AS labels, CAST(sum(inh) AS BIGINT) AS inherited FROM al GROUP BY 1""",
}
