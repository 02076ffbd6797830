import json

import numpy as np

from samplewright import cli
from samplewright.sources import images


def test_a_job_by_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    (tmp_path / "in").mkdir()
    for i in range(3):
        x = np.full((30, 40, 3), 115.0) + rng.normal(0, 1, (30, 40, 3))
        x[8:20, 10 : 22 + i] = (20, 230, 50)
        (tmp_path / "in" / f"{i}.png").write_bytes(images.encode_png(np.round(x).astype(np.uint8)))
    good = {"name": "c", "dataset": {"path": str(tmp_path / "in")}, "target": {"classes": ["block"]}, "replacement": {"values": ["taxi"]}, "quality": {"minimum_overall": 0.3}}
    recipe, bad = tmp_path / "r.yaml", tmp_path / "bad.yaml"
    recipe.write_text(json.dumps(good))
    bad.write_text(json.dumps(good | {"nonsense": 1}))
    out = str(tmp_path / "job")
    assert cli.main(["inspect", str(tmp_path / "in")]) == 0
    assert cli.main(["recipe", str(bad)]) == 2 and cli.main(["nothing"]) == 2
    assert cli.main(["plan", str(recipe), "--samples", "10"]) == 0 and cli.main(["workflow", str(recipe)]) == 0
    assert cli.main(["run", str(recipe), "--out", out]) == 0
    assert cli.main(["qa", out, str(recipe)]) == 0 and cli.main(["report", out]) == 0
    assert cli.main(["export", out, str(recipe), "--out", str(tmp_path / "x")]) == 1  # a demo generator
    recipe.write_text(json.dumps(good | {"allow_demo_backends": True}))
    assert cli.main(["export", out, str(recipe), "--out", str(tmp_path / "x")]) == 0
    spec = tmp_path / "v.json"
    spec.write_text(json.dumps({"id": "v", "operators": [{"name": "speed", "axis": "pace", "domains": {"factor": [0.5, 2]}}]}))
    assert cli.main(["video", str(spec)]) == 0
    assert "accepted" in capsys.readouterr().out


def scene(rng, shade, left, top, w, h):
    x = np.full((30, 40, 3), shade) + rng.normal(0, 1, (30, 40, 3))
    x[top : top + h, left : left + w] = (20, 230, 50)
    return images.encode_png(np.round(x).clip(0, 255).astype(np.uint8))


def test_exports_hold_no_duplicates_and_no_leaks(spark, tmp_path, capsys):
    rng = np.random.default_rng(3)
    (tmp_path / "in" / "train").mkdir(parents=True)
    first, other = scene(rng, 115, 8, 6, 12, 14), scene(rng, 115, 20, 16, 15, 9)
    for name, data in (("a", first), ("copy", first), ("b", other)):
        (tmp_path / "in" / "train" / f"{name}.png").write_bytes(data)
    doc = {"name": "c", "allow_demo_backends": True, "dataset": {"path": str(tmp_path / "in"), "split_mode": "directory"}, "target": {"classes": ["block"]}, "replacement": {"values": ["taxi"]}, "quality": {"minimum_overall": 0.3}}
    recipe, out = tmp_path / "r.yaml", str(tmp_path / "job")
    recipe.write_text(json.dumps(doc))
    assert cli.main(["run", str(recipe), "--out", out]) == 0
    decided = {r["sample_id"]: r["candidate_id"] for r in spark.read.parquet(f"{out}/decided").filter("decision = 'accepted'").collect()}
    hashes = {r["candidate_id"]: r["hash"] for r in spark.read.parquet(f"{out}/hashes").collect()}
    assert len(decided) == 3 and len(hashes) == 3 and spark.read.parquet(f"{out}/source_hashes").count() == 3
    # Hashes far apart, but for those of the copies.
    far = {"train/a.png": 0, "train/copy.png": 3, "train/b.png": -1}
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{out}/{name}")
    put([(c, s, far[s], "phash") for s, c in decided.items()], "candidate_id string, ord string, hash bigint, algorithm string", "hashes")
    put([("s", 0xFFFF0000, "phash")], "item string, hash bigint, algorithm string", "source_hashes")

    def export(folder, *more):
        capsys.readouterr()
        code = cli.main(["export", out, str(recipe), "--out", str(tmp_path / folder), *more])
        return code, set() if code else {r["candidate_id"] for r in spark.read.parquet(str(tmp_path / folder / "provenance")).collect()}

    assert export("x") == (0, {decided["train/a.png"], decided["train/b.png"]})
    assert [r["reference"] for r in spark.read.parquet(str(tmp_path / "x" / "duplicates")).collect()] == [decided["train/a.png"]]
    reviews = tmp_path / "reviews.csv"
    reviews.write_text(f"candidate_id,decision\n{decided['train/a.png']},rejected\n{decided['train/b.png']},needs_review\n")
    assert export("y", "--reviews", str(reviews)) == (0, {decided["train/copy.png"]})
    recipe.write_text(json.dumps(doc | {"export": {"include_review": True}}))
    assert export("z", "--reviews", str(reviews)) == (0, {decided["train/copy.png"], decided["train/b.png"]})
    samples = [tuple(r) for r in spark.read.parquet(f"{out}/samples").select("id", "root", "split").collect()]
    assert {s[2] for s in samples} == {"train"}
    put([*samples, ("val/a.png", samples[0][1], "val")], "id string, root string, split string", "samples")
    assert export("w")[0] == 1


def test_unread_files_are_refused_and_grey_is_read(spark, tmp_path):
    rng = np.random.default_rng(4)
    (tmp_path / "in").mkdir()
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x20\x00\x30" + b"\0" * 20
    grey = np.full((30, 40), 115, np.uint8)
    grey[8:20, 10:24] = 250
    deep = bytearray(scene(rng, 115, 8, 6, 12, 14))
    deep[24] = 16  # bits a channel, which its lines do not have
    broken = scene(rng, 115, 8, 6, 12, 14)[:60]
    for name, data in (("a.jpg", jpeg), ("b.png", bytes(deep)), ("c.png", broken), ("d.png", images.encode_png(grey)), ("e.png", scene(rng, 115, 8, 6, 12, 14)), ("f.png", scene(rng, 115, 8, 6, 12, 14))):
        (tmp_path / "in" / name).write_bytes(data)
    doc = {"name": "c", "dataset": {"path": str(tmp_path / "in"), "max_samples": 2}, "target": {"classes": ["block"]}, "replacement": {"values": ["taxi"]}, "quality": {"minimum_overall": 0.3}}
    recipe, out = tmp_path / "r.yaml", str(tmp_path / "job")
    recipe.write_text(json.dumps(doc))
    assert cli.main(["run", str(recipe), "--out", out]) == 0
    assert {r["sample_id"] for r in spark.read.parquet(f"{out}/detections").collect()} == {"d.png", "e.png"}
    refused = {r["relative_path"]: (r["error_code"], bool(r["reason"])) for r in spark.read.parquet(f"{out}/refused").collect()}
    assert refused == {"a.jpg": ("MEDIA_UNSUPPORTED", True), "b.png": ("MEDIA_UNREADABLE", True), "c.png": ("MEDIA_UNREADABLE", True)}
    for name in "bcdef":
        (tmp_path / "in" / f"{name}.png").unlink()
    assert cli.main(["run", str(recipe), "--out", out]) == 1


def test_only_the_named_splits_are_augmented_and_labels_come_from_the_dataset(spark, tmp_path):
    rng = np.random.default_rng(5)
    for split in ("train", "val"):
        (tmp_path / "in" / "images" / split).mkdir(parents=True)
        (tmp_path / "in" / "labels" / split).mkdir(parents=True)
        (tmp_path / "in" / "images" / split / "a 1.png").write_bytes(scene(rng, 115, 8, 6, 12, 14))
        # The block (8, 6) to (20, 20), and an object that no detector sees.
        (tmp_path / "in" / "labels" / split / "a 1.txt").write_text("# block, bird\n0 0.35 0.433333 0.3 0.466667\n1 0.75 0 1 0 1 0.25\n")
    (tmp_path / "in" / "classes.txt").write_text("block\nbird\n")
    coco = {"images": [{"id": 1, "file_name": "./images/train/a 1.png", "width": 40, "height": 30}], "categories": [{"id": 1, "name": "block"}, {"id": 2, "name": "bird"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [8, 6, 12, 14]}, {"id": 2, "image_id": 1, "category_id": 2, "bbox": [30, 0, 10, 7.5], "area": 37.5}]}
    (tmp_path / "in" / "annotations.json").write_text(json.dumps(coco))
    dataset = {"path": str(tmp_path / "in"), "split_mode": "directory", "annotations": "yolo"}
    doc = {"name": "c", "dataset": dataset, "target": {"classes": ["block"]}, "replacement": {"values": ["taxi"]}, "quality": {"minimum_overall": 0.3}}
    recipe, out = tmp_path / "r.yaml", str(tmp_path / "job")
    recipe.write_text(json.dumps(doc))
    assert cli.main(["run", str(recipe), "--out", out]) == 0
    assert [r["sample_id"] for r in spark.read.parquet(f"{out}/detections").collect()] == ["images/train/a 1.png"]
    assert {(r["id"], r["split"]) for r in spark.read.parquet(f"{out}/samples").collect()} == {("images/train/a 1.png", "train"), ("images/val/a 1.png", "val")}
    written = {(r["category"], r["origin"]): tuple(r[e] for e in ("x_min", "y_min", "x_max", "y_max", "area")) for r in spark.read.parquet(f"{out}/labels").collect()}
    assert set(written) == {("bird", "inherited"), ("taxi", "regenerated")} and written["bird", "inherited"] == (30.0, 0.0, 40.0, 7.5, 37.5)
    from samplewright.sources import labels

    files = spark.createDataFrame([("images/train/a 1.png", 40, 30)], "relative_path string, width int, height int")
    box = lambda form: {(r["image"], r["category"], *(round(r[e], 3) for e in ("x_min", "y_min", "x_max", "y_max", "area"))) for r in labels.of_samples(files, form, str(tmp_path / "in")).collect()}
    assert box("coco") == box("yolo") == {("images/train/a 1.png", "block", 8.0, 6.0, 20.0, 20.0, 168.0), ("images/train/a 1.png", "bird", 30.0, 0.0, 40.0, 7.5, 37.5)}
    recipe.write_text(json.dumps(doc | {"dataset": dataset | {"augment_splits": ["dev"]}}))
    assert cli.main(["run", str(recipe), "--out", out]) == 1
