from pyspark.sql import functions as F

from samplewright.functions import geometry as g
from samplewright.functions import identity
from samplewright.operators import dedup, lineage, report, select

DET = "sample_id string, object_id string, class_name string, score double, area double, x_min double, y_min double, x_max double, y_max double"


def det(spark, rows):
    return spark.createDataFrame(rows, DET)


ROWS = [("s", "a", "car", 0.9, 100.0, 0.0, 0.0, 10.0, 10.0), ("s", "b", "car", 0.9, 50.0, 5.0, 5.0, 15.0, 15.0), ("s", "c", "cat", 0.99, 80.0, 0.0, 0.0, 9.0, 10.0), ("s", "d", "car", 0.2, 80.0, 0.0, 0.0, 1.0, 1.0), ("s", "e", None, None, None, None, None, None, None)]


def test_selection_and_its_counters(spark):
    d = det(spark, ROWS)
    got = [(r["object_id"], r["ordinal"]) for r in select.select_targets(d, ["car"], 0.5, 1.0, 5).orderBy("ordinal").collect()]
    assert got == [("a", 0), ("b", 1)]  # ties by id
    c = select.drop_counters(d, ["car"], 0.5, 1.0, 1).first()
    assert (c["n_objects"], c["dropped_class"], c["dropped_score"], c["dropped_area"], c["dropped_cap"], c["selected"]) == (5, 2, 1, 0, 1, 1)
    assert [r["object_id"] for r in select.select_targets(d, ["car"], 0.0, 0.0, 5, strategy="largest").collect()] == ["a"]
    assert [r["object_id"] for r in select.select_targets(d, [], 0.0, 0.0, 5, strategy="explicit", wanted=["c"]).collect()] == ["c"]


def test_best_match_keeps_the_unfound(spark):
    wanted = det(spark, [ROWS[0], ("t", "x", "car", 0.9, 1.0, 0.0, 0.0, 1.0, 1.0)])
    out = {r["object_id"]: r for r in select.best_match(wanted, det(spark, ROWS[1:])).collect()}
    assert out["a"]["match_id"] == "c" and out["a"]["found"] and abs(out["a"]["iou"] - 0.9) < 1e-9
    assert out["x"]["match_id"] is None and not out["x"]["found"]


def test_occlusions(spark):
    out = {r["other_id"]: r["relation"] for r in select.occlusions(det(spark, ROWS[:1]), det(spark, ROWS[:4])).collect()}
    assert out == {"b": "overlapping", "c": "behind", "d": "behind"}


def test_iou_is_symmetric_and_guarded(spark):
    row = spark.range(1).select(*[F.lit(float(v)).alias(n) for n, v in zip([*g.EDGES, *[f"o_{e}" for e in g.EDGES]], (0, 0, 4, 4, 2, 2, 6, 6), strict=True)])
    a, b = row.select(g.iou(g.box(), g.box("o_")), g.iou(g.box("o_"), g.box())).first()
    assert a == b == 4 / 28
    flat = {e: F.lit(1.0) for e in g.EDGES}
    assert spark.range(1).select(g.iou(flat, flat), g.aspect(flat)).first() == (0.0, 0.0)


def test_identities(spark):
    import hashlib

    path = spark.range(1).select(identity.sample_id(F.lit("r"), F.lit(".\\..\\a/b.png"))).first()[0]
    assert path == "s_" + hashlib.sha256(b'{"path":"a/b.png","root":"r"}').hexdigest()[:16]
    assert spark.range(1).select(identity.quantise(F.lit(5.0), 2.0), identity.quantise(F.lit(3.0), 2.0)).first() == (4.0, 4.0)  # halves to even
    box = {e: F.lit(v) for e, v in zip(g.EDGES, (0.9, -0.4, 10.0, 21.1), strict=True)}
    made = spark.range(1).select(identity.object_id(F.lit("x"), F.lit(0), F.lit("c"), box, F.lit(0.51))).first()[0]
    assert made == "o_" + hashlib.sha256(b'{"asset":"x","box":[0.0,0.0,10.0,22.0],"class":"c","frame":0,"score":0.5}').hexdigest()[:12]


def test_object_ids_are_those_of_python(spark):
    """Every multiple of 0.05 as Python multiplies and prints it, and names that JSON must escape."""
    import hashlib
    import json

    rows = [(f'c"{i}\\\n', i / 40, 1.5 * i) for i in range(41)]
    box = {e: F.col("x") + k for k, e in enumerate(g.EDGES)}
    made = [r[0] for r in spark.createDataFrame(rows, "name string, score double, x double").coalesce(1).select(identity.object_id(F.lit("x"), F.lit(3), F.col("name"), box, F.col("score"))).collect()]
    q = lambda v, by: round(v / by) * by + 0.0
    texts = [json.dumps({"asset": "x", "box": [q(x + k, 2.0) for k in range(4)], "class": n, "frame": 3, "score": q(s, 0.05)}, separators=(",", ":"), ensure_ascii=False) for n, s, x in rows]
    assert made == ["o_" + hashlib.sha256(t.encode()).hexdigest()[:12] for t in texts] and any("0.7000000000000001" in t for t in texts)


def test_splits(spark):
    f = lambda fn, p: spark.range(1).select(fn(F.lit(p))).first()[0]
    assert f(lineage.split_from_directory, "x/Valid/a.png") == "val"
    assert f(lineage.split_from_directory, "x/y/train.png") == "unassigned"
    assert f(lineage.split_from_filename, "d/img_test_1.png") == "test"
    assert f(lineage.split_from_filename, "train_001.png") == "train"
    assert lineage.protected_splits_allowed(["train", "val"], False, False) and not lineage.protected_splits_allowed(["val"], True, False) and lineage.protected_splits_allowed(["val"], True, True)


def test_ancestors_by_the_shortest_way_and_through_a_cycle(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a"), ("a", "c")], "child string, parent string")
    got = {(r["ancestor"], r["depth"]) for r in lineage.ancestors(edges, spark.createDataFrame([("c",)], "id string")).collect()}
    assert got == {("b", 1), ("a", 1), ("c", 2)}


def test_ancestors_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(67)], "child string, parent string").coalesce(1)
    got = {(r["ancestor"], r["depth"]) for r in lineage.ancestors(edges, spark.createDataFrame([("n0",)], "id string")).collect()}
    assert got == {(f"n{i}", i) for i in range(1, 68)}


def test_leaks(spark):
    samples = spark.createDataFrame([("a", "train", "r"), ("b", "val", "r"), ("c", None, "q")], "id string, split string, root string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a")], "child string, parent string")
    assert [(r["child"], r["parent_split"]) for r in lineage.split_leaks(edges, samples).collect()] == [("b", "train")]
    assert [r["root"] for r in lineage.roots_in_many_splits(samples).collect()] == ["r"]


def test_ordered_duplicates_against_brute_force(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(120):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            h ^= 1 << rng.randrange(64)
        rows.append((i, i, h - (1 << 64) if h >> 63 else h))
    rows += [(500, 500, None), (501, 501, None)]
    refs = [("r", rows[3][2])]
    kept, want = [("r", rows[3][2])], {}
    for item, _, h in rows:
        near = [(bin((h ^ k) & (2**64 - 1)).count("1"), n != "r", n) for n, k in kept] if h is not None else []
        near = [x for x in near if x[0] <= 6]
        want[item] = min(near)[0] if near else None
        if not near and h is not None:
            kept.append((item, h))
    out = dedup.resolve(spark.createDataFrame(rows, "item bigint, ord bigint, hash bigint").withColumn("item", F.col("item").cast("string")), spark.createDataFrame(refs, "item string, hash bigint"))
    got = {int(r["item"]): r["distance"] for r in out.collect()}
    assert got == want


def test_tracks_and_transitions(spark):
    obs = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (2, 7)], "track_id bigint, frame bigint")
    assert [tuple(r) for r in report.track_gaps(obs).collect()] == [(1, 3, 4)]
    assert {r["track_id"]: r["continuity"] for r in report.track_continuity(obs).collect()} == {1: 0.6, 2: 1.0}
    ev = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y")], "candidate_id string, seq bigint, state string")
    assert [(r["from_state"], r["state"]) for r in report.transitions(ev).orderBy("seq").collect()] == [(None, "x"), ("x", "y")]
