"""Reading and writing COCO and YOLO label files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions import geometry as g
from samplewright.operators import annotations
from samplewright.session import arrow_files, scratch, settle, ship

# Where a COCO document is looked for, in this order.
COCO_PLACES = ("annotations/instances_train.json", "annotations/instances_val.json", "annotations/instances_test.json", "annotations/instances_default.json", "annotations.json")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_coco(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every COCO document of a dataset folder, or of a lone JSON file in it; a broken document raises."""
    found = [f"{folder}/{p}" for p in COCO_PLACES if _exists(spark, f"{folder}/{p}")]
    reader = spark.read.schema(annotations.COCO_SCHEMA).option("multiLine", True).option("mode", "FAILFAST")
    if not found:
        lone = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path").limit(2).collect()
        if len(lone) != 1:
            raise FileNotFoundError(f"no COCO document in {folder}")
        found = [lone[0]["path"]]
    return annotations.from_coco(reader.json(found))


def _write_files(files: DataFrame, folder: str) -> int:
    """Write rows ``path, value`` as files of these names below a folder, each by the task that holds it; returns how many.

    A file is written under another name and then moved, so a task that is repeated leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = arrow_files(folder)
        for batch in batches:
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{base}/{path}"
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                part = f"{place}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(value.encode())
                system.move(part, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    ship(files.sparkSession)
    return files.select("path", "value").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _assemble(lines: DataFrame, order: list[str], path: str) -> None:
    """One text file of the ordered rows' ``value``, without line ends between them."""
    spark = lines.sparkSession
    made = scratch(spark, "text")
    lines.orderBy(*order).select("value").coalesce(1).write.option("lineSep", "\n").text(made)
    to = spark._jvm.org.apache.hadoop.fs.Path
    system = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in to(made).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(to(made)) if s.getPath().getName().startswith("part-"))
    system.mkdirs(to(path).getParent())
    system.delete(to(path), True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(part.getFileSystem(spark._jsc.hadoopConfiguration()), part, system, to(path), True, spark._jsc.hadoopConfiguration())


def write_coco(labels: DataFrame, folder: str, split: str = "train", description: str = "") -> None:
    """``annotations/instances_SPLIT.json``, one document for each split in a column ``split``, or for ``split`` if there is none.

    Rows are formed on the executors; only the assembled JSON text passes through one task, as the format asks for one file.
    """
    if "split" not in labels.columns:
        labels = labels.withColumn("split", F.lit(split))
    labels = settle(labels, "coco-labels")
    words = annotations.vocabulary(labels)  # of all splits: a class has one number
    head = json.dumps({"description": description})
    for name in sorted(r[0] for r in labels.select("split").distinct().collect()):
        _coco_document(labels.filter(F.col("split") == name).drop("split"), words, f"{folder}/annotations/instances_{name}.json", head)


def _coco_document(labels: DataFrame, words: DataFrame, path: str, head: str) -> None:
    rows = annotations.coco_annotations(labels, words)
    sizes = labels.groupBy("image").agg(F.first("image_width").cast("int").alias("width"), F.first("image_height").cast("int").alias("height"))
    images = annotations.running_number(sizes, ["image"], "id").select("id", F.col("image").alias("file_name"), "width", "height")
    categories = words.select(F.col("category_id").cast("bigint").alias("id"), F.col("category").alias("name"))
    parts = [df.select(F.lit(i).alias("part"), F.col("id").alias("at"), F.to_json(F.struct(*df.columns)).alias("value")) for i, df in ((1, images), (2, rows), (3, categories))]
    lines = settle(reduce(DataFrame.unionByName, parts), "coco-lines")
    starts = lines.groupBy("part").agg(F.min("at").alias("first"))  # three rows
    lines = lines.join(F.broadcast(starts), "part").select("part", "at", F.when(F.col("at") == F.col("first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    last = 2**62
    frame = [(0, 0, f'{{"info":{head},"licenses":[],"images":['), (1, last, '],"annotations":['), (2, last, '],"categories":['), (3, last, "]}")]
    _assemble(lines.unionByName(labels.sparkSession.createDataFrame(frame, "part int, at bigint, value string")), ["part", "at"], path)


def read_yolo(spark: SparkSession, folder: str, everywhere: bool = False) -> DataFrame:
    """Label lines below ``labels`` of a folder (of the whole folder if it has none, or ``everywhere``), with names from ``classes.txt`` or ``data.yaml`` beside them; errors stand in their rows."""
    names: list[str] = []
    if _exists(spark, f"{folder}/classes.txt"):
        names = [r["value"].strip() for r in spark.read.text(f"{folder}/classes.txt").collect() if r["value"].strip()]
    elif _exists(spark, f"{folder}/data.yaml"):
        import yaml

        listed = yaml.safe_load("\n".join(r["value"] for r in spark.read.text(f"{folder}/data.yaml").collect())).get("names", [])
        names = [listed[k] for k in sorted(listed)] if isinstance(listed, dict) else list(listed)
    place = folder if everywhere or not _exists(spark, f"{folder}/labels") else f"{folder}/labels"
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(place, wholetext=True).withColumn("path", F.input_file_name()).filter(~F.col("path").endswith("classes.txt"))
    lines = lines.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")).withColumn("line_no", F.col("line_no") + 1).filter(~F.trim("value").startswith("#"))
    return annotations.from_yolo_lines(lines, names)


def of_samples(samples: DataFrame, form: str, folder: str) -> DataFrame:
    """Source labels of samples ``relative_path, width, height``, under ``image`` the relative path; form ``coco`` or ``yolo``.

    A COCO entry belongs to the sample of its file name. A YOLO file lies below ``labels`` (for a sample below ``images``, in its place) or beside the image; the first one that
    exists counts, and a line of it that is no label raises.
    """
    columns = ["image", "object_id", "category", *g.EDGES, "area", "iscrowd", "polygon"]
    if form == "coco":
        named = read_coco(samples.sparkSession, folder).withColumn("image", F.ltrim(F.replace("image", F.lit("\\"), F.lit("/")), F.lit("./")))
        return named.join(samples.select(F.col("relative_path").alias("image")), "image", "left_semi").select(*columns)
    spark = samples.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    below = lambda path: F.substring(F.regexp_replace(path, "^[a-z0-9]+:/*(?=/)", ""), len(base) + 2, 1 << 20)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder).select(below(F.col("path")).alias("file"))
    stem = F.regexp_replace("relative_path", r"\.[^./]*$", "")
    places = F.array(F.when(stem.startswith("images/"), F.regexp_replace(stem, "^images/", "labels/")), F.concat(F.lit("labels/"), stem), stem)
    wanted = samples.select("relative_path", "width", "height", F.posexplode(places).alias("rank", "file")).filter("file is not null").withColumn("file", F.concat("file", F.lit(".txt")))
    chosen = wanted.join(there, "file").groupBy("relative_path", "width", "height").agg(F.min_by("file", "rank").alias("file"))
    # Names of text files come percent-encoded.
    lines = read_yolo(spark, folder, everywhere=True).withColumn("file", below(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))))
    lines = settle(lines.join(chosen, "file"), "yolo")
    if wrong := lines.filter("error in ('too_few_fields', 'not_a_number')").select("file", "line_no", "error").limit(1).collect():
        raise ValueError(f"{wrong[0]['file']} line {wrong[0]['line_no']}: {wrong[0]['error']}")
    c, w, h = (lambda i: F.get("coords", F.lit(i))), F.col("width"), F.col("height")
    ring = F.transform(F.col("coords"), lambda v, i: v * F.when(i % 2 == 0, w).otherwise(h))
    even, odd = F.filter(ring, lambda _, i: i % 2 == 0), F.filter(ring, lambda _, i: i % 2 == 1)
    boxed = F.col("kind") == "box"
    raw = {"x_min": F.when(boxed, (c(0) - c(2) / 2) * w).otherwise(F.array_min(even)), "y_min": F.when(boxed, (c(1) - c(3) / 2) * h).otherwise(F.array_min(odd)), "x_max": F.when(boxed, (c(0) + c(2) / 2) * w).otherwise(F.array_max(even)), "y_max": F.when(boxed, (c(1) + c(3) / 2) * h).otherwise(F.array_max(odd))}
    clipped = g.clip(raw, w, h)
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size(ring) / 2).cast("int") - 1), lambda i: F.struct(F.get(ring, i * 2).alias("x"), F.get(ring, i * 2 + 1).alias("y")))
    rows = lines.filter("error is null").select(F.col("relative_path").alias("image"), "line_no", "category", *[v.alias(e) for e, v in clipped.items()], F.when(boxed, g.area(clipped)).otherwise(g.polygon_area(points)).alias("area"), F.lit(0).alias("iscrowd"), F.when(~boxed, ring).alias("polygon"))
    return annotations.number_objects(rows.filter("x_max > x_min and y_max > y_min"), "line_no").select(*columns)


def write_yolo(labels: DataFrame, folder: str, split: str = "train") -> None:
    """``labels/SPLIT/STEM.txt`` for each image, ``classes.txt`` and ``data.yaml``; a column ``split`` goes before the argument.

    An image without its ending gives the file's name, folders in it are kept.
    """
    if "split" not in labels.columns:
        labels = labels.withColumn("split", F.lit(split))
    labels = settle(labels, "yolo-labels")
    words = annotations.vocabulary(labels)
    rows = annotations.rebase(labels, words).select("split", F.regexp_replace("image", r"\.[^./]*$", "").alias("stem"), "object_id", annotations.yolo_line(F.col("category_id"), F.col("image_width"), F.col("image_height")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("object_id", "line"))), lambda s: F.concat(s["line"], F.lit("\n")))  # of one image
    files = rows.groupBy("split", "stem").agg(F.array_join(lines, "").alias("value"))
    _write_files(files.select(F.concat(F.lit("labels/"), "split", F.lit("/"), "stem", F.lit(".txt")).alias("path"), "value"), folder)
    names = [r["category"] for r in words.orderBy("category_id").collect()]  # a vocabulary
    splits = sorted(r[0] for r in labels.select("split").distinct().collect())
    doc = ["path: .", *(f"{s}: images/{s}" for s in splits), f"nc: {len(names)}", f"names: {json.dumps(names, ensure_ascii=False)}"]
    beside = [("classes.txt", "".join(f"{n}\n" for n in names)), ("data.yaml", "\n".join(doc) + "\n")]
    _write_files(labels.sparkSession.createDataFrame(beside, "path string, value string").coalesce(1), folder)
