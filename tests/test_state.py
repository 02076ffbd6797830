"""Run tables, cache, artifact store and small operators that no registered query covers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from samplewright.functions import segments
from samplewright.operators import dedup, select, state


def test_upsert_takes_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), (None, 1, 0)], "k string, v int, at int")
    new = spark.createDataFrame([("b", 5, 2), ("b", 9, 1), ("c", 3, 1), (None, 7, 1)], "k string, v int, at int")
    assert sorted((r["k"] or "", r["v"]) for r in state.upsert(old, new, ["k"], ["at"]).collect()) == [("", 7), ("a", 1), ("b", 5), ("c", 3)]
    assert state.upsert(old, new.limit(0), ["k"]).count() == 3


def test_artifacts_are_stored_once_and_verified(spark, tmp_path):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = spark.createDataFrame([(sha(b"x"), bytearray(b"x")), (sha(b"x"), bytearray(b"x")), (sha(b"y"), bytearray(b"z")), ("n", None), (sha(b"long"), bytearray(b"long"))], "digest string, content binary")
    folder = str(tmp_path / "store")
    refused = {r["problem"] for r in state.write_once(rows, folder, most_bytes=3).collect()}
    assert refused == {"digest differs", "no content", "too large"} and spark.read.parquet(folder).count() == 1
    state.write_once(rows.limit(1), folder)
    good, lost = state.read_artifacts(spark, folder, spark.createDataFrame([(sha(b"x"),), (sha(b"q"),)], "digest string"))
    assert [bytes(r["content"]) for r in good.collect()] == [b"x"] and [r[0] for r in lost.collect()] == [sha(b"q")]


def test_cache_and_event_log(spark, tmp_path):
    planned = spark.createDataFrame([("n1", "k1"), ("n2", "k2")], "node string, cache_key string")
    hit, todo = state.split_by_cache(planned, spark.createDataFrame([("k1", "r"), ("k1", "r")], "cache_key string, result_digest string"))
    assert [r["node"] for r in hit.collect()] == ["n1"] and [r["node"] for r in todo.collect()] == ["n2"]
    (tmp_path / "log.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id"')
    assert sorted(r["id"] for r in state.read_event_log(spark, str(tmp_path), "id int").collect()) == [1, 2]


def test_area_cosine_and_latest(spark):
    box = {e: F.lit(float(v)) for e, v in zip(("x_min", "y_min", "x_max", "y_max"), (0, 0, 2.5, 2), strict=True)}
    assert spark.range(1).select(select.object_area(F.lit(7), box), select.object_area(F.lit(0), box)).first() == (7, 5)
    pair = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in pair.select(dedup.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, at int")
    assert sorted(tuple(r) for r in dedup.latest_first(rows, "k", "at").collect()) == [("a", 3), ("b", 2)]


def test_cosine_matches_against_every_pair(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 3)))] + [(60, [0.0, 0.0, 0.0]), (61, []), (62, None), (63, [1.0, 2.0]), (64, [2.0, 4.0])]
    monkeypatch.setattr(dedup, "ITEM_BLOCK", 7)
    df = spark.createDataFrame(vectors, "id bigint, vector array<float>")
    got = {(r["query"], r["item"]) for r in dedup.cosine_matches(df.filter("id % 3 = 0"), df, 0.9).collect()}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if a and b and len(a) == len(b) and any(a) and any(b) else 0.0
    assert got == {(i, j) for i, a in vectors for j, b in vectors if i % 3 == 0 and cos(a, b) >= 0.9}


@pytest.mark.parametrize("threshold", [0, 3, 6])
def test_hash_pairs_against_every_pair(spark, threshold):
    import random

    rng = random.Random(threshold)
    values = [rng.getrandbits(63) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 8))) for v in values]
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(min(a, b), max(a, b)) for a in values for b in values if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= threshold}
    got = [(r["a"], r["b"]) for r in dedup.hash_pairs(spark.createDataFrame([(v,) for v in [*values, *values[:5], None]], "hash bigint"), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pieces_leave_enough_for_every_threshold():
    for tau in range(0, 9):
        for n in (0, 10**5, 10**9):
            assert segments.pieces_for(n, tau) > tau
