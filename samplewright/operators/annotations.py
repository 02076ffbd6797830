"""The internal label relation and its COCO and YOLO forms.

Labels are rows ``image, object_id, category, x_min .. y_max, area, iscrowd, polygon`` (polygon: flat x, y pairs of the outer ring).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from samplewright.functions import geometry as g
from samplewright.session import settle

COCO_SCHEMA = """info STRUCT<description:STRING>, licenses ARRAY<STRING>, images ARRAY<STRUCT<id:BIGINT, file_name:STRING, width:INT, height:INT>>,
annotations ARRAY<STRUCT<id:BIGINT, image_id:BIGINT, category_id:INT, bbox:ARRAY<DOUBLE>, area:DOUBLE, iscrowd:INT, segmentation:ARRAY<ARRAY<DOUBLE>>>>, categories ARRAY<STRUCT<id:INT, name:STRING>>"""


def slug(name: Column) -> Column:
    """Lower case, everything else than letters and digits as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def from_coco(documents: DataFrame) -> DataFrame:
    """Labels of COCO documents, tolerantly: entries without an image or with an empty box are left out, and only the outer ring is kept.

    A category id that the document does not declare becomes ``category_N``.
    """
    documents = settle(documents.withColumn("__doc", F.monotonically_increasing_id()), "coco")  # stored, so that all three parts see the same numbers
    images = documents.select("__doc", F.inline("images")).select("__doc", F.col("id").alias("image_id"), F.col("file_name").alias("image"), F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    categories = documents.select("__doc", F.inline("categories")).select("__doc", F.col("id").alias("category_id"), F.col("name").alias("category"))
    rows = documents.select("__doc", F.inline("annotations"))
    rows = rows.filter((F.size("bbox") >= 4) & (F.get("bbox", F.lit(2)) > 0) & (F.get("bbox", F.lit(3)) > 0))
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    rows = rows.select("__doc", "id", "image_id", "category_id", x.alias("x_min"), y.alias("y_min"), (x + w).alias("x_max"), (y + h).alias("y_max"), F.coalesce("area", w * h).alias("area"), F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"), F.get("segmentation", F.lit(0)).alias("polygon"))
    named = rows.join(images, ["__doc", "image_id"]).join(categories, ["__doc", "category_id"], "left").withColumn("category", F.coalesce("category", F.concat(F.lit("category_"), "category_id")))
    return number_objects(named.drop("__doc", "image_id", "category_id"), "id").drop("id")


def number_objects(labels: DataFrame, order: str) -> DataFrame:
    """``object_id`` as slug and running number within the image, in the given order."""
    place = F.row_number().over(W.partitionBy("image").orderBy(order)) - 1
    return labels.withColumn("object_id", F.format_string("%s_%04d", slug(F.col("category")), place))


def vocabulary(labels: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """``category, category_id``: declared ids stay, unknown names follow the highest id in order of their names."""
    names = labels.select("category").distinct()
    if declared is None:
        return names.withColumn("category_id", (F.row_number().over(W.orderBy("category")) - 1).cast("int"))
    top = declared.agg(F.coalesce(F.max("category_id"), F.lit(-1))).first()[0]
    new = names.join(declared, "category", "left_anti")
    new = new.select("category", (F.lit(top) + F.row_number().over(W.orderBy("category"))).cast("int").alias("category_id"))
    return declared.select("category", "category_id").unionByName(new)


def rebase(labels: DataFrame, target: DataFrame) -> DataFrame:
    """Category ids of another vocabulary, by name."""
    return labels.drop("category_id").join(target.select("category", "category_id"), "category", "left")


def coco_annotations(labels: DataFrame, words: DataFrame) -> DataFrame:
    """Annotation rows with ids from 1 over all images; a box without a polygon becomes its four corners."""
    b = g.box()
    corners = F.array(b["x_min"], b["y_min"], b["x_max"], b["y_min"], b["x_max"], b["y_max"], b["x_min"], b["y_max"])
    ring = F.when(F.size("polygon") >= 6, F.col("polygon")).otherwise(corners)
    two = lambda c: F.round(c, 2)
    numbered = running_number(labels, ["image", "object_id"], "id")  # stored, so the labels are not computed again for their images
    numbered = numbered.join(running_number(numbered.select("image").distinct(), ["image"], "image_id"), "image")
    return rebase(numbered, words).select("id", "image_id", "category_id", F.array(two(b["x_min"]), two(b["y_min"]), two(g.width(b)), two(g.height(b))).alias("bbox"), two(F.col("area")).alias("area"), "iscrowd", F.array(F.transform(ring, two)).alias("segmentation"))


def running_number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers from 1 in a global order, without one task seeing all rows.

    Rows are range partitioned; each partition numbers its own, and the sizes of the partitions before it are added.
    """
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    ranged = settle(ranged, "numbered")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("__p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return ranged.join(F.broadcast(starts), "__p").withColumn(name, F.col("__i") - F.col("first") + F.col("base") + 1).drop("__p", "__i", "first", "base")


def yolo_line(index: Column, w: Column, h: Column) -> Column:
    """``class cx cy w h`` or ``class x1 y1 x2 y2 ...``, clamped to [0, 1], 6 decimals."""
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    b = {e: unit(v) for e, v in g.normalise(g.box(), w, h).items()}
    box = F.array((b["x_min"] + b["x_max"]) / 2, (b["y_min"] + b["y_max"]) / 2, b["x_max"] - b["x_min"], b["y_max"] - b["y_min"])
    points = F.transform(F.col("polygon"), lambda v, i: unit(v / F.when(i % 2 == 0, w).otherwise(h)))
    numbers = F.when(F.size("polygon") >= 6, points).otherwise(box)
    return F.concat_ws(" ", index.cast("string"), F.concat_ws(" ", F.transform(numbers, lambda v: F.format_string("%.6f", v))))


def from_yolo_lines(lines: DataFrame, names: list[str]) -> DataFrame:
    """``path, line_no, class_index, category, kind, coords, error`` of label lines ``path, line_no, value``.

    Fewer than five fields, a field that is no number, and an odd or too short polygon are errors in the row; an unknown index is ``class_N``.
    """
    parts = F.split(F.trim(F.col("value")), r"\s+")
    numbers = F.transform(F.slice(parts, 2, F.size(parts)), lambda v: F.expr("NULL") if v is None else v.try_cast("double"))
    out = lines.filter(F.trim("value") != "").withColumn("__n", F.size(parts)).withColumn("class_index", F.get(parts, F.lit(0)).try_cast("int")).withColumn("coords", numbers)
    bad = F.when(F.col("__n") < 5, "too_few_fields").when(F.col("class_index").isNull() | F.exists("coords", lambda v: v.isNull()), "not_a_number").when((F.col("__n") > 5) & ((F.size("coords") % 2 == 1) | (F.size("coords") < 6)), "bad_polygon")
    known = F.get(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"), F.col("class_index"))
    return out.select("path", "line_no", "class_index", F.coalesce(F.when(F.col("class_index") >= 0, known), F.concat(F.lit("class_"), "class_index")).alias("category"), F.when(F.col("__n") == 5, "box").otherwise("polygon").alias("kind"), "coords", bad.alias("error"))


def rebuild(source: DataFrame, regenerated: DataFrame, least_iou: float = 0.5, covered: Column | None = None) -> DataFrame:
    """Labels of a produced image: what it inherits from its source and the regenerated target.

    ``regenerated`` holds ``image, source_image, object_id, category, x_min .. y_max, area, iscrowd, polygon, found`` and the replaced box ``r_x_min ..``. The replaced
    object is found by IoU, since detectors number objects differently; inherited labels that the new object covers drop out (by default, whose box lies whole in the new one; ``covered`` may test its ``mask``, which then stands under ``n_mask, n_width, n_height`` beside the inherited label, see
    :func:`samplewright.operators.raster.covered`), and an object that was not found leaves no label at all.
    """
    present = regenerated.filter("found")
    inherited = source.withColumnRenamed("image", "source_image").join(present.select("image", "source_image", *[F.col(c).alias(f"n_{c}") for c in [*g.EDGES, "mask", "width", "height"] if c in present.columns], *[f"r_{e}" for e in g.EDGES]), "source_image")
    own, new, replaced = g.box(), g.box("n_"), g.box("r_")
    if covered is None:
        covered = (own["x_min"] >= new["x_min"]) & (own["y_min"] >= new["y_min"]) & (own["x_max"] <= new["x_max"]) & (own["y_max"] <= new["y_max"])
    kept = inherited.filter(~covered & (g.iou(own, replaced) < least_iou)).withColumn("origin", F.lit("inherited"))
    columns = ["image", "object_id", "category", *g.EDGES, "area", "iscrowd", "polygon", "origin"]
    return kept.select(*columns).unionByName(present.withColumn("origin", F.lit("regenerated")).select(*columns))
