import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.operators import annotations, backends, export, gates, video
from samplewright.plans import guard, pipeline, recipe, stages
from samplewright.sources import images, labels

RNG = np.random.default_rng(5)


def test_png_round_trip_and_probes():
    for channels in (1, 3):
        x = RNG.integers(0, 256, (9, 11, channels)).astype(np.uint8)
        assert (images.decode_png(images.encode_png(x)) == x).all()
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x20\x00\x30" + b"\0" * 20
    assert images.probe(jpeg)["width"] == 48 and images.probe(jpeg)["height"] == 32
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert (images.probe(webp)["width"], images.probe(webp)["height"]) == (100, 50)
    mp4 = b"\0\0\0\x18ftypisom" + b"\0" * 12 + b"mvhd" + b"\0" * 12 + (1000).to_bytes(4, "big") + (2500).to_bytes(4, "big")
    assert images.probe(mp4)["duration_s"] == 2.5
    assert images.probe(b"hello")["reason"] == "unknown format" and images.probe(b"\x89PNG\r\n\x1a\n")["reason"] == "truncated header"


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("interlace", [0, 1])
def test_png_depths_and_interlace(depth, interlace):
    """Against an encoder of its own: each pass by itself, every line by another filter."""
    import struct
    import zlib

    for w, h in ((1, 1), (5, 3), (13, 11)):
        for colour, channels in ((0, 1), *(((2, 3), (4, 2), (6, 4)) if depth >= 8 else ((3, 1),))):
            x = RNG.integers(0, 1 << depth, (h, w, channels))
            lines = b""
            for x0, y0, dx, dy in images.PASSES if interlace else ((0, 0, 1, 1),):
                part = x[y0::dy, x0::dx]
                if not part.size:
                    continue
                flat = part.reshape(len(part), -1)
                raw = flat.astype(">u2").view(np.uint8).reshape(len(part), -1) if depth == 16 else np.packbits((flat[..., None] >> np.arange(depth)[::-1] & 1).reshape(len(part), -1).astype(np.uint8), axis=1)
                step = max(1, channels * depth // 8)
                above = np.zeros(raw.shape[1], int)
                for y, line in enumerate(raw.astype(int)):
                    left, corner = (np.r_[np.zeros(step, int), v][: len(v)] for v in (line, above))
                    p = left + above - corner
                    paeth = [a if abs(q - a) <= min(abs(q - b), abs(q - c)) else b if abs(q - b) <= abs(q - c) else c for q, a, b, c in zip(p, left, above, corner, strict=True)]
                    lines += bytes([y % 5]) + ((line - [0 * left, left, above, (left + above) // 2, paeth][y % 5]) & 255).astype(np.uint8).tobytes()
                    above = line
            palette = RNG.integers(0, 256, (1 << depth if depth < 16 else 1, 3)).astype(np.uint8)
            chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"crc!"
            data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)) + (chunk(b"PLTE", palette.tobytes()) if colour == 3 else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
            want = palette[x[..., 0]] if colour == 3 else (x >> 8 if depth == 16 else x * (255 // ((1 << depth) - 1)))[..., : 1 if colour in (0, 4) else 3]
            assert (images.decode_png(data) == want).all(), (w, h, colour)


def test_png_filters():
    import struct
    import zlib

    x = RNG.integers(0, 256, (5, 4, 3)).astype(np.uint8).astype(int)
    lines = []
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        row = []
        for i in range(12):
            left = x[y].ravel()[i - 3] if i >= 3 else 0
            up = x[y - 1].ravel()[i] if y else 0
            corner = x[y - 1].ravel()[i - 3] if y and i >= 3 else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            row.append((x[y].ravel()[i] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        lines.append(bytes([kind, *row]))
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines)))
    assert (images.decode_png(data) == x).all()


def test_discovery_and_ingest(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "labels").mkdir()
    png = images.encode_png(RNG.integers(0, 256, (6, 8, 3)).astype(np.uint8))
    for name, data in (("train/a.png", png), (".hidden/b.png", png), ("labels/c.png", png), ("d.png", b"junk"), ("e.mp4", b"\0\0\0\x18ftypisom"), ("f.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    found = images.discover(spark, str(tmp_path))
    rows = {r["relative_path"]: r for r in found.collect()}
    assert set(rows) == {"train/a.png", "d.png", "e.mp4"} and (rows["train/a.png"]["width"], rows["train/a.png"]["height"]) == (8, 6)
    good, bad = images.ingest(found, spark.createDataFrame([("train/a.png", "0" * 64)], "relative_path string, digest string"))
    assert good.count() == 0 and {r["relative_path"]: r["error_code"] for r in bad.collect()} == {"train/a.png": "SOURCE_CHANGED", "d.png": "MEDIA_UNREADABLE", "e.mp4": "MEDIA_UNSUPPORTED"}
    content = spark.createDataFrame([("a", bytearray(png)), ("b", bytearray(b"x")), ("c", None)], "relative_path string, content binary")
    decoded = {r["relative_path"]: r for r in images.pixels(content).collect()}
    assert decoded["a"]["width"] == 8 and decoded["a"]["error"] is None and decoded["b"]["error"] and decoded["c"]["error"]


def test_jpeg_with_metadata_beyond_the_head(spark, tmp_path):
    segment = b"\xff\xe1\x80\x00" + bytes(RNG.integers(0, 255, 0x8000 - 2).astype(np.uint8))
    frame = b"\xff\xc0\x00\x11\x08\x00\x20\x00\x30" + b"\0" * 20
    for name, data in (("a", b"\xff\xd8" + segment * 3 + frame), ("b", b"\xff\xd8" + frame), ("c", b"\xff\xd8" + segment * 3)):
        (tmp_path / f"{name}.jpg").write_bytes(data)
    got = {r["relative_path"]: (r["kind"], r["width"], r["height"], r["reason"]) for r in images.discover(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": ("jpeg", 48, 32, None), "b.jpg": ("jpeg", 48, 32, None), "c.jpg": ("jpeg", None, None, "no frame header")}


LABELS = "image string, object_id string, category string, x_min double, y_min double, x_max double, y_max double, area double, iscrowd int, polygon array<double>, image_width double, image_height double"


def some_labels(spark):
    rows = [("b.png", "car_0000", "car", 1.0, 2.0, 5.0, 8.0, 24.0, 0, None, 20.0, 10.0), ("a.png", "bus_0000", "bus", 0.0, 0.0, 4.0, 4.0, 8.0, 0, [0.0, 0.0, 4.0, 0.0, 4.0, 4.0], 20.0, 10.0), ("a.png", "car_0001", "car", 3.0, 3.0, 9.0, 9.0, 36.0, 1, None, 20.0, 10.0)]
    return spark.createDataFrame(rows, LABELS)


def test_coco_round_trip(spark, tmp_path):
    named = some_labels(spark).withColumn("split", F.when(F.col("image") == "b.png", "val").otherwise("train"))
    labels.write_coco(named, str(tmp_path), description='a "set"')
    doc = json.loads((tmp_path / "annotations" / "instances_train.json").read_text())
    assert [i["id"] for i in doc["images"]] == [1] and [c["name"] for c in doc["categories"]] == ["bus", "car"] and [a["id"] for a in doc["annotations"]] == [1, 2] and doc["info"]["description"] == 'a "set"'
    assert [c["name"] for c in json.loads((tmp_path / "annotations" / "instances_val.json").read_text())["categories"]] == ["bus", "car"]
    again = {(r["image"], r["category"], r["x_min"], r["y_max"], r["area"]) for r in labels.read_coco(spark, str(tmp_path)).collect()}
    assert again == {("b.png", "car", 1.0, 8.0, 24.0), ("a.png", "bus", 0.0, 4.0, 8.0), ("a.png", "car", 3.0, 9.0, 36.0)}


def test_yolo_round_trip(spark, tmp_path):
    named = some_labels(spark).withColumns({"split": F.when(F.col("image") == "b.png", "val").otherwise("train"), "image": F.when(F.col("image") == "a.png", "deep er/a.x.png").otherwise(F.col("image"))})
    labels.write_yolo(named, str(tmp_path))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".crc") == ["classes.txt", "data.yaml", "labels/train/deep er/a.x.txt", "labels/val/b.txt"]
    assert (tmp_path / "classes.txt").read_text() == "bus\ncar\n" and 'names: ["bus", "car"]' in (tmp_path / "data.yaml").read_text()
    for names in ("classes.txt", "data.yaml"):
        out = [(r["category"], r["kind"], r["error"], len(r["coords"])) for r in labels.read_yolo(spark, str(tmp_path)).collect()]
        assert sorted(out) == [("bus", "polygon", None, 6), ("car", "box", None, 4), ("car", "box", None, 4)]
        (tmp_path / names).unlink()


def test_coco_edges(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        labels.read_coco(spark, str(tmp_path))
    (tmp_path / "x.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a", "width": 2, "height": 2}], "annotations": [{"id": 1, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}, {"id": 2, "image_id": 7, "category_id": 9, "bbox": [0, 0, 1, 1]}, {"id": 3, "image_id": 1, "category_id": 9, "bbox": [0, 0, 0, 1]}], "categories": []}))
    assert [(r["category"], r["area"]) for r in labels.read_coco(spark, str(tmp_path)).collect()] == [("category_9", 1.0)]


def test_yolo(spark, tmp_path):
    (tmp_path / "classes.txt").write_text("bus\ncar\n")
    (tmp_path / "a.txt").write_text("1 0.5 0.5 0.2 0.2\n0 0 0 1 0 1 1\n7 0.5 0.5 0.1 0.1\n1 x 0.5 0.2 0.2\n1 0.5\n1 0 0 1 0 1\n\n")
    out = {r["line_no"]: (r["category"], r["kind"], r["error"]) for r in labels.read_yolo(spark, str(tmp_path)).collect()}
    assert out == {1: ("car", "box", None), 2: ("bus", "polygon", None), 3: ("class_7", "box", None), 4: ("car", "box", "not_a_number"), 5: ("car", "polygon", "too_few_fields"), 6: ("car", "polygon", "bad_polygon")}
    line = some_labels(spark).select("object_id", annotations.yolo_line(F.lit(1), F.col("image_width"), F.col("image_height")).alias("l"))
    got = {r["object_id"]: r["l"] for r in line.collect()}
    assert got["car_0000"] == "1 0.150000 0.500000 0.200000 0.600000" and got["bus_0000"].split()[1:] == ["0.000000", "0.000000", "0.200000", "0.000000", "0.200000", "0.400000"]


def test_regenerated_labels_have_outlines_and_cover_by_mask(spark):
    x = np.full((3, 40, 48), 0.45)
    x[:, 10:30, 8:32] = 0.95
    x[:, 10:18, 8:16] = 0.45  # the block lacks a corner
    picture = spark.createDataFrame([("s", 48, 40, bytearray(np.round(x * 255).astype(np.uint8).tobytes()))], "sample_id string, width int, height int, pixels binary")
    job = pipeline.run(picture, recipe.load({"name": "j", "dataset": {"path": "."}, "target": {"classes": ["block"]}, "replacement": {"values": ["sedan"]}, "quality": {"minimum_overall": 0.1}}))
    inside, corner = (20.0, 20.0, 26.0, 26.0), (9.0, 11.0, 14.0, 16.0)
    source = spark.createDataFrame([("s", f"o{i}", "thing", *b, 9.0, 0, None) for i, b in enumerate((inside, corner))], "image string, object_id string, category string, x_min double, y_min double, x_max double, y_max double, area double, iscrowd int, polygon array<double>")
    made = pipeline.labels(job, ("accepted", "needs_review", "rejected"), source).collect()
    assert {r["object_id"] for r in made if r["origin"] == "inherited"} == {"o1"}  # in the box, but not under the mask
    new = next(r for r in made if r["origin"] == "regenerated")
    assert len(new["polygon"]) >= 12 and (min(new["polygon"][::2]), max(new["polygon"][::2])) == (new["x_min"], new["x_max"])


def test_replacement_strategies_and_what_is_preserved():
    base = {"name": "x", "dataset": {"path": "a"}}
    of = lambda **r: recipe.load(base | r)
    assert of(replacement={"strategy": "description", "description": " a red van "}).replacement.choices == ("a red van",)
    assert of(replacement={"strategy": "reference", "references": ["in/van 1.png", "b.c.jpg"]}).replacement.choices == ("van 1", "b.c")
    assert of(preserve={"background": "loose", "pose": False, "area_max": 2.0}).preserve.limits["area_ratio_max"] == 2.0
    assert of(preserve={"background": "loose", "pose": False}).preserve.request == ", keep lighting, scale, position, occlusion"
    for wrong in ({"replacement": {"strategy": "reference"}}, {"replacement": {"strategy": "description"}}, {"preserve": {"area_min": 2.0}}, {"preserve": {"background": "no"}}, {"target": {"strategy": "explicit"}}):
        with pytest.raises(recipe.RecipeError):
            of(**wrong)


def test_recipe_reports_every_problem():
    with pytest.raises(recipe.RecipeError) as e:
        recipe.load({"name": "x", "dataset": {"path": 1, "foo": 2}, "target": {"strategy": "no"}})
    assert len(e.value.problems) == 3
    with pytest.raises(recipe.RecipeError):
        recipe.load({"name": "x", "dataset": {"path": "a", "augment_splits": ["val"]}})
    a, b = (recipe.load({"name": "x", "dataset": {"path": "a"}, "seed": s}) for s in (1, 2))
    assert a.hash != b.hash and {g.metric for g in a.policy().gates} == {"artifact_free", "target_presence"}


def test_workflow_documents_are_edited_by_compare_and_swap():
    doc = stages.document(stages.StagePlan(2, 3))
    assert stages.validate(doc) == [] and stages.StagePlan(2, 3).nodes_per_sample == 45
    new = stages.edit(doc, doc["digest"], [{"op": "set_config", "node": "detect.objects", "config": {"min_score": 0.3}}])
    assert new["digest"] != doc["digest"]
    with pytest.raises(stages.DocumentError):
        stages.edit(new, doc["digest"], [])
    with pytest.raises(stages.DocumentError):
        stages.edit(doc, doc["digest"], [{"op": "add_edge", "edge": {"from": "export.sample", "to": "ingest.image"}}])


def test_guards(spark):
    bound, problems = guard.resolve(["image.replacement.v1", "x"], [{"id": "d", "capabilities": ["image.replacement.v1"], "demo_only": True}])
    assert problems == ["x: no provider"] and guard.demo_backends(bound) and not guard.demo_backends(bound, True)
    doc = {"api_key": "abc", "token": "env:T", "nested": [{"password": "p", "candidate_key": "c", "key_ref": "k"}], "secret": None}
    assert guard.secret_places(doc) == ["$.api_key", "$.nested[0].password"]
    rows = spark.createDataFrame([({"api_key": "x", "a": "b", "token": "env:t"},)], "m map<string,string>")
    assert [tuple(r) for r in guard.secret_columns(rows, "m").collect()] == [("api_key", 1)]


def test_ledger_never_sends_twice(spark, tmp_path):
    ledger = backends.Ledger(spark, str(tmp_path))
    log = tmp_path / "log"
    log.mkdir()

    def send(batch):
        import uuid

        import pandas as pd

        (log / uuid.uuid4().hex).write_text("\n".join(batch["request_key"]))
        if "bad" in set(batch["payload"]):
            raise RuntimeError("lost")
        return pd.DataFrame({"request_key": batch["request_key"], "status": "succeeded", "result": batch["payload"]})

    requests = spark.createDataFrame([("a", "1"), ("b", "bad"), ("a", "1")], "request_key string, payload string").repartition(2, "request_key")
    for _ in range(2):
        out = {r["request_key"]: r["status"] for r in ledger.submit(requests, send).collect()}
    assert out["a"] in ("succeeded", "unknown") and out["b"] == "unknown"
    assert sorted("\n".join(p.read_text() for p in log.iterdir()).split()) == ["a", "b"]


def test_a_job_end_to_end(spark, tmp_path):
    rows = []
    for i in range(6):
        x = np.full((3, 30, 40), 0.45) + RNG.normal(0, 0.005, (3, 30, 40))
        x[:, 8:20, 10 : 20 + i] = np.array([0.1, 0.9, 0.2])[:, None, None]
        rows.append((f"s{i}", 40, 30, bytearray(np.round(x * 255).astype(np.uint8).tobytes())))
    pictures = spark.createDataFrame(rows, "sample_id string, width int, height int, pixels binary")
    r = recipe.load({"name": "j", "dataset": {"path": "."}, "target": {"classes": ["block"]}, "replacement": {"values": ["sedan"], "candidates_per_object": 2}, "quality": {"minimum_overall": 0.4}})
    job = pipeline.run(pictures, r)
    assert job["detections"].count() == 6 and job["candidates"].count() == 12
    decided = job["decided"].collect()
    assert len(decided) == 12 and all(0 <= d["overall"] <= 1 for d in decided)
    assert {d["candidate_id"]: d["overall"] for d in decided} == {d["candidate_id"]: d["overall"] for d in pipeline.run(pictures, r)["decided"].collect()}
    made = pipeline.labels(job)
    accepted = {d["candidate_id"] for d in decided if d["decision"] == "accepted"}
    assert {x["image"] for x in made.collect()} == accepted
    rows = export.provenance(job["decided"].filter("decision = 'accepted'"), job["targets"], {"recipe": r.hash})
    with pytest.raises(export.ExportError):
        export.export(rows, made, str(tmp_path / "o"), {}, bindings={"image.replacement.v1": {"id": "builtin_replacement", "demo_only": True}})
    with pytest.raises(export.ExportError):
        export.export(rows, made, str(tmp_path / "o"), {"api_key": "x"})
    sized = made.withColumns({"image_width": F.lit(40.0), "image_height": F.lit(30.0)})
    manifest = export.export(rows, sized, str(tmp_path / "o"), {"recipe": r.hash})
    assert manifest["exported"] == len(accepted)
    flipped = export.review_override(job["decided"], spark.createDataFrame([(decided[0]["candidate_id"], "rejected")], "candidate_id string, decision string"))
    assert flipped.filter(F.col("decision") == "rejected").count() >= 1
    assert "<table>" in export.review_page(job["decided"])


def test_images_with_several_objects(spark):
    rows, blocks = [], ((6, 4, 10, 12), (26, 6, 7, 9), (8, 24, 24, 12))  # x, y, width, height; the last one is the largest
    for i in range(3):
        x = np.full((3, 40, 48), 0.45) + RNG.normal(0, 0.005, (3, 40, 48))
        for n, (left, top, w, h) in enumerate(blocks):
            x[:, top : top + h, left + i : left + i + w] = np.array([0.05, 0.95, 0.9 if n == 2 else 0.05])[:, None, None]
        x[:, 1:3, 44:45] = 1  # a speck
        rows.append((f"s{i}", 48, 40, bytearray(np.round(x * 255).astype(np.uint8).tobytes())))
    pictures = spark.createDataFrame(rows, "sample_id string, width int, height int, pixels binary")
    r = recipe.load({"name": "j", "dataset": {"path": "."}, "target": {"classes": ["block"], "max_per_sample": 3}, "replacement": {"values": ["sedan"]}, "quality": {"minimum_overall": 0.4}})
    job = pipeline.run(pictures, r)
    want = {(f"s{i}", float(x + i), float(y), float(x + i + w), float(y + h), w * h - 4) for i in range(3) for x, y, w, h in blocks}  # opening takes the corners
    assert {(d["sample_id"], d["x_min"], d["y_min"], d["x_max"], d["y_max"], d["area"]) for d in job["detections"].collect()} == want
    assert job["targets"].count() == 9 and job["detections"].select("object_id").distinct().count() == 9
    measured = job["measured"].collect()
    assert len(measured) == 9 and all(m["found"] and m["redetect_iou"] >= 0.5 for m in measured)
    made = pipeline.labels(job).groupBy("image").count().collect()
    assert made and all(m["count"] == 3 for m in made)


def test_the_detector_names_orders_and_limits(spark):
    x = np.full((3, 40, 48), 0.45)
    for left, top, w, h, level in ((4, 4, 8, 8, 0.7), (20, 4, 14, 14, 1.0), (6, 24, 10, 10, 0.95)):
        x[:, top : top + h, left : left + w] = level
    x[0, 30:34, 30:40] += 0.3  # a tint that hardly changes the brightness
    picture = spark.createDataFrame([("s", 48, 40, bytearray(np.round(x * 255).astype(np.uint8).tobytes()))], "sample_id string, width int, height int, pixels binary")
    see = lambda **more: [(r["class_name"], r["x_min"]) for r in backends.call(picture, backends.detector(**more)).orderBy(F.desc("score")).collect()]
    assert see(classes=("b", "a")) == [("a", 20.0), ("b", 6.0), ("a", 4.0), ("b", 30.0)]
    assert see(classes=("b", "z"), vocabulary=("a", "b"), most=2) == [("b", 20.0), ("b", 6.0)]
    assert see(classes=("z",), vocabulary=("a",)) == [] and see(least_score=0.95) == [("object", 20.0)]


def test_a_job_segments_analyses_and_labels(spark):
    x = np.full((3, 30, 40), 0.45) + RNG.normal(0, 0.005, (3, 30, 40))
    x[:, 8:20, 10:22] = np.array([0.1, 0.9, 0.2])[:, None, None]
    x[:, 20:21, 10:22] = 0.59  # a weak lower edge
    pictures = spark.createDataFrame([("s", 40, 30, bytearray(np.round(x * 255).astype(np.uint8).tobytes()))], "sample_id string, width int, height int, pixels binary")
    job = pipeline.run(pictures, recipe.load({"name": "j", "dataset": {"path": "."}, "target": {"classes": ["block"]}, "replacement": {"values": ["sedan"]}, "quality": {"minimum_overall": 0.4}}))
    assert job["detections"].first()["area"] == 152  # opening takes the corners, which the segmenter brings back
    made = job["candidates"].first()
    assert made["area"] == sum(made["mask"]) == 156 and len(made["polygon"]) >= 8 and made["prompt"] == "a sedan in place of the block, a flat mid-tone background, keep background, lighting, pose, scale, position, occlusion"
    assert job["segments"].count() == 1 and {r["image"] for r in job["labels"].collect()} == {r["candidate_id"] for r in job["decided"].filter("decision = 'accepted'").collect()}


def test_an_erased_object_is_rejected(spark):
    wide = spark.createDataFrame([("a", False, 0.0, 0.2)], "candidate_id string, found boolean, coverage double, expected_coverage double")
    from samplewright.operators import outcomes

    out = gates.decide(outcomes.presence(wide), gates.Policy(0.1, 0.0, True, (gates.Gate("target_presence", 0.6),))).first()
    assert out["decision"] == "rejected" and out["reason_codes"][0] == "OBJECT_NOT_FOUND"


def test_video_golden_facts(spark):
    ops = (video.Operator("speed", "pace", {"factor": [0.5, 2.0]}), video.Operator("grade", "look", {"tone": ["a", "b"]}))
    rows = video.variants(spark, video.Spec("street", 7, "paired", 16, None, ops))
    pairs = video.contrast_pairs(rows)
    assert rows.count() == 5 and pairs.count() == 6 and {r["relation"] for r in pairs.collect()} == {"identity-invariance", "pace-invariance", "look-invariance"}
    assert video.variants(spark, video.Spec("s", 7, "full-factorial", 3, None, ops)).count() == 3
    assert video.variants(spark, video.Spec("s", 7, "full-factorial", 9, 1, ops)).count() == 0
    t = video.label_transform("reframe", {"source_aspect": 2.0, "aspect": 1.0})
    assert (t["w"], t["h"], t["y"]) == (1.0, 0.5, 0.25)


def test_seeds_colours_and_registry(spark):
    import colorsys

    from samplewright.functions import colour, seeds
    from samplewright.plans.registry import Operators

    assert seeds.derive(1, "a") != seeds.derive(1, "b") and 0 <= seeds.derive(1, "a") < 2**63
    got = spark.createDataFrame([("s", 1), (None, 2)], "a string, b int").select(seeds.derive_column(7, F.coalesce("a", F.lit("-")), F.col("b")).alias("x")).collect()
    assert [r["x"] for r in got] == [seeds.derive(7, "s", "1"), seeds.derive(7, "-", "2")]
    rows = [tuple(float(v) for v in RNG.random(3)) for _ in range(30)] + [(0.0, 0.0, 0.0), (0.5, 0.5, 0.5)]
    made = spark.createDataFrame(rows, "r double, g double, b double").select(*[c.alias(n) for n, c in colour.hsv(F.col("r"), F.col("g"), F.col("b")).items()]).collect()
    assert all(np.allclose((m["hue"] / 360, m["saturation"], m["value"]), colorsys.rgb_to_hsv(*r)) for m, r in zip(made, rows, strict=True))
    assert spark.range(1).select(colour.hue_distance(F.lit(350.0), F.lit(20.0))).first()[0] == 30
    x = RNG.random((2, 3, 8, 8))
    assert np.allclose(colour.histograms(x).reshape(2, 3, 3).sum(-1), 1) and colour.grid_occupancy(x[:, 0] > 0.5).shape == (2, 16)
    ops = Operators()
    ops.register("a", "1", len, recipe.Target)
    assert ops.configure("a", {"min_score": 0.5}).min_score == 0.5
    for wrong in (lambda: ops.configure("a", {"x": 1}), lambda: ops.register("a", "2", len), lambda: ops.get("b")):
        with pytest.raises((ValueError, KeyError)):
            wrong()


def test_covered_objects_by_mask(spark):
    from samplewright.operators import raster

    mask = np.zeros((6, 8), np.uint8)
    mask[1:5, 2:6] = 1
    df = spark.createDataFrame([(bytearray(mask.tobytes()), 8, 6, *b) for b in ((2.0, 1.0, 6.0, 5.0), (2.0, 1.0, 7.0, 5.0), (3.0, 3.0, 3.0, 3.0))], "mask binary, width int, height int, x_min double, y_min double, x_max double, y_max double")
    assert [r[0] for r in df.select(raster.covered(*df.columns)).collect()] == [True, False, False]
