"""Operators on tables against brute force, with dirty, empty, tied and repeated rows."""

import math
import os
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from samplewright.functions import segments
from samplewright.llm import band_topn, history_dedup, keep_fraction, minwise, percentile_sketch, split_overlap

DATA = "/root/testdata/sf0.01"
CAND = "candidate_id string, job_id string, sample_id string, target_object_id string, category string, state string, output_digest string, overall_score double, updated_at timestamp, cat string, n int, s double, h bigint"
T0 = datetime(2026, 3, 1)


def candidates(spark, rows):
    """Rows of (id, job, sample, object, category, state, digest, score, minutes); the last columns clash with names used inside."""
    return spark.createDataFrame([(*r[:8], None if r[8] is None else T0 + timedelta(minutes=r[8]), "x", 1, 0.5, 7) for r in rows], CAND)


def cand(i, job="j1", sample="s", obj="o", cat="suv", state="accepted", dig=None, score=0.5, at=0):
    return (i, job, sample, obj, cat, state, dig, score, at)


# ---- problem 2 --------------------------------------------------------------------------------------------------


def cut_by_hand(rows, targets):
    best = {}
    for r in rows:
        if r[0] is not None and (r[0] not in best or (r[8] or 0) > (best[r[0]][8] or 0)):
            best[r[0]] = r
    groups = defaultdict(list)
    for r in best.values():
        if r[4] is not None and r[7] is not None and not math.isnan(r[7]) and 0 <= r[7] <= 1:
            groups[r[4].strip().lower().replace("_", "-").replace(" ", "-")].append((r[7], r[0]))
    out = set()
    for c, permille in targets.items():
        scores = sorted(groups.get(c, []), reverse=True)
        k = -(-len(scores) * permille // 1000)
        if scores and k > 0:
            out |= {(c, i) for s, i in scores if s >= scores[min(k, len(scores)) - 1][0]}
    return out


def kept(spark, rows, targets, **more):
    scored = keep_fraction.settled_candidates(candidates(spark, rows))
    cuts = keep_fraction.cutoffs(scored, spark.createDataFrame(targets, "category string, keep_permille int, n int"), **more)
    return {tuple(r) for r in keep_fraction.kept(scored, cuts).collect()}, {r["cat"]: r for r in cuts.collect()}


def test_cutoffs_against_sorting(spark):
    rng = random.Random(1)
    rows = [cand(f"c{i}", cat=rng.choice(["suv", " SUV", "City Bus", "city_bus\t", "van", None]), score=rng.choice([None, float("nan"), -0.1, 1.5, 0.5, 0.5, round(rng.random(), 2), rng.random()])) for i in range(900)]
    rows += [(*r[:7], 0.99, 5) for r in rows[:40]] + rows[100:140]  # newer versions and rows sent twice
    rows += [cand(None, score=0.9), cand("z", cat="suv", score=None, at=9)]
    targets = [("Suv ", 100, 1), ("city-bus", 667, 1), ("nothing", 500, 1), ("van", None, 1), (None, 500, 1), ("SUV", 50, 1)]
    got, cuts = kept(spark, rows, targets)
    assert got == cut_by_hand(rows, {"suv": 100, "city-bus": 667})
    for c, r in cuts.items():
        assert r["kept"] == sum(x[0] == c for x in got) and r["kept"] >= r["k"]


@pytest.mark.parametrize("permille", [1, 500, 999, 1000, 5000, 0])
def test_cutoffs_with_narrowing_and_one_hot_category(spark, permille):
    rng = random.Random(permille)
    rows = [cand(f"c{i}", cat="suv", score=rng.random()) for i in range(3000)] + [cand(f"t{i}", cat="bus", score=0.25) for i in range(300)]
    got, _ = kept(spark, rows, [("suv", permille, 0), ("bus", permille, 0)], sort_values=5)
    assert got == cut_by_hand(rows, {"suv": min(permille, 1000), "bus": min(permille, 1000)})


def test_cutoffs_of_nothing(spark):
    assert kept(spark, [], [("suv", 100, 1)]) == (set(), {})
    assert kept(spark, [cand("a")], []) == (set(), {})


# ---- problem 4 --------------------------------------------------------------------------------------------------


def test_top_n_against_sorting(spark):
    rng = random.Random(2)
    rows = [cand(f"c{i}", sample=rng.choice([None, "n", "vn", "a", "hot", "hot", "hot"]), obj=rng.choice([None, "o", "hot"]), score=rng.choice([None, float("nan"), 2.0, 0.5, 0.5, 0.25, 0.0, rng.random()])) for i in range(1500)]
    rows += rows[:50] + [cand(None, sample="hot", obj="hot", score=1.0)]
    groups = defaultdict(list)
    for r in {r[0]: r for r in rows}.values():
        if r[0] and r[7] is not None and 0 <= r[7] <= 1:
            groups[r[2], r[3]].append((-r[7], r[0]))
    want = {(*g, i) for g, items in groups.items() for _, i in sorted(items)[:3]}
    got = [tuple(r) for r in band_topn.top_candidates(candidates(spark, rows)).select("sample_id", "target_object_id", "candidate_id").collect()]
    assert len(got) == len(want) and set(got) == want
    assert band_topn.top_candidates(candidates(spark, [])).count() == 0


def test_top_n_when_all_scores_tie(spark):
    rows = [cand(f"c{i:03}", score=0.5) for i in range(100)]
    assert sorted(r["candidate_id"] for r in band_topn.top_candidates(candidates(spark, rows), 4).collect()) == ["c000", "c001", "c002", "c003"]


# ---- problem 5 --------------------------------------------------------------------------------------------------

RUN = "job_id string, node_id string, operator string, status string, attempt int, cache_hit int, backend_id string, started_at timestamp, duration_ms bigint, n bigint, sketch string"


def test_percentiles_stay_within_the_stated_error(spark):
    rng = random.Random(3)
    values = [int(rng.lognormvariate(5, 2)) for _ in range(30_000)]
    rows = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "duration_ms bigint, day int")
    runs = rows.select(F.lit("op").alias("operator"), F.lit("b").alias("backend_id"), F.date_add(F.lit("2026-01-01"), "day").alias("run_day"), "duration_ms")
    daily = percentile_sketch.daily_sketches(runs.repartition(6), 100)
    out = percentile_sketch.percentiles(daily, 100, (0.5, 0.9, 0.99)).first()
    values.sort()
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        below, upto = sum(v < out[name] for v in values), sum(v <= out[name] for v in values)
        assert below / 30_000 - 2 * percentile_sketch.rank_error(100) <= q <= upto / 30_000 + 2 * percentile_sketch.rank_error(100)
    assert out["n"] == 30_000


def test_slow_days_and_what_counts(spark):
    rows = []
    for day in range(6):
        for i in range(20):
            slow = 100 if day == 3 else 10
            rows.append(("j", f"{day}-{i}", "op", "succeeded", 1, 0, "b", T0 + timedelta(days=day), slow + i % 3, 0, "x"))
    rows += [("j", f"few{i}", "op", "succeeded", 1, 0, "b", T0 + timedelta(days=20), 900, 0, "x") for i in range(11)]
    bad = [("failed", 1, 0, "b", T0, 999), ("succeeded", 1, 1, "b", T0, 999), ("succeeded", 1, 0, None, T0, 999), ("succeeded", 1, 0, "b", None, 999), ("succeeded", 1, 0, "b", T0, -1), ("succeeded", 1, 0, "b", T0, None), (None, 1, 0, "b", T0, 9)]
    rows += [("j", f"bad{k}-{i}", "op", s, a, c, b, t, d, 0, "x") for k, (s, a, c, b, t, d) in enumerate(bad) for i in range(30)]
    rows += [("j", f"0-{i}", "op", "failed", 2, 0, "b", T0, 5000, 0, "x") for i in range(10)]  # a later attempt hides the first
    rows += rows[:30] + [(None, "x", "op", "succeeded", 1, 0, "b", T0, 1, 0, "x")]
    df = spark.createDataFrame(rows, RUN)
    assert [tuple(r) for r in percentile_sketch.slow_days(df).collect()] == [("op", "b", "2026-03-04")]
    assert percentile_sketch.counted_runs(df).count() == 6 * 20 - 10 + 11
    assert percentile_sketch.slow_days(df.limit(0)).count() == 0


# ---- segment index ----------------------------------------------------------------------------------------------


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def near_family(rng, n, most=8):
    out = [rng.getrandbits(64) for _ in range(n // 4)] + [0, (1 << 64) - 1]
    while len(out) < n:
        h = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(0, most)):
            h ^= 1 << b
        out.append(h)
    return out


@pytest.mark.parametrize("pieces", [8, 9, 10])
def test_no_near_pair_is_lost_or_given_twice(spark, pieces):
    values = sorted(set(near_family(random.Random(4), 300)))
    want = {(signed(a), signed(b), bin(a ^ b).count("1")) for a in values for b in values if bin(a ^ b).count("1") <= 6}
    keys = segments.index(spark.createDataFrame([(signed(v),) for v in values], "h bigint"), "h", pieces)
    got = [tuple(r) for r in segments.near_pairs(keys, keys, pieces).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    among = [tuple(r) for r in segments.near_among(keys, pieces).collect()]
    assert len(among) == len(set(among)) and set(among) == {x for x in want if x[2]}


def test_keys_grow_with_the_strings_so_that_buckets_do_not():
    sizes = [10**k for k in range(11)]
    pieces = [segments.pieces_for(n) for n in sizes]
    assert pieces == sorted(pieces) and pieces[0] == 8
    assert all(n / 2 ** (64 * (p - 6) // p) <= segments.BUCKET for n, p in zip(sizes, pieces, strict=True))


# ---- problem 1 --------------------------------------------------------------------------------------------------


def greedy(history, batch):
    """Brute force; history and batch of (digest, hash), batch in order with ids."""
    digests, hashes, cases = [d for d, _ in history if d], [h for _, h in history if h is not None], []
    for i, d, h in batch:
        if (d and any(d.startswith(x) or x.startswith(d) for x in digests)) or (h is not None and any(bin(h ^ x).count("1") <= 6 for x in hashes)):
            cases.append(i)
        else:
            digests += [d] if d else []
            hashes += [h] if h is not None else []
    return cases


def dedup_tables(spark, samples, batch, jobs=3):
    s = spark.createDataFrame([(f"s{i}", st, d, None if h is None else f"{h:x}", "clash") for i, (st, d, h) in enumerate(samples)], "sample_id string, state string, digest string, perceptual_hash string, id string")
    c = candidates(spark, [cand(i, job=f"j{k}", dig=d) for i, k, d, _ in batch])
    p = spark.createDataFrame([(i, None if h is None else f" 0X{h:016X}", T0, 1) for i, _, _, h in batch], "candidate_id string, perceptual_hash string, created_at timestamp, ord int")
    j = spark.createDataFrame([(f"j{k}", T0 + timedelta(days=jobs - k)) for k in range(jobs)], "job_id string, created_at timestamp")
    return c, p, j, s


def hexes(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_batches_against_greedy_search(spark, seed):
    rng = random.Random(seed)
    pool = near_family(rng, 60)
    digests = [hexes(rng, 64) for _ in range(25)]
    digests += [digests[0][:20] + hexes(rng, 44), digests[0][:16]]  # a short digest equals two that differ
    pick = lambda: rng.choice([None, rng.choice(digests), rng.choice(digests)[:16], hexes(rng, 64)])
    value = lambda: rng.choice([None, rng.choice(pool), rng.choice(pool), rng.getrandbits(64)])
    samples = [(rng.choice(["source", "accepted", "rejected", None]), pick(), value()) for _ in range(20)]
    batch = [(f"c{i:03}", rng.randrange(3), pick(), value()) for i in range(250)]
    tables = dedup_tables(spark, samples, batch)
    order = sorted(batch, key=lambda r: (-r[1], r[0]))
    want = greedy([(d, h) for st, d, h in samples if st in ("source", "accepted")], [(i, d, h) for i, _, d, h in order])
    assert sorted(r[0] for r in history_dedup.found(*tables).collect()) == sorted(want)
    decided = history_dedup.decisions(*tables).collect()
    assert sorted(r["candidate_id"] for r in decided) == sorted(want)
    assert all((r["kind"] == "exact") == (r["distance"] == 0) and r["distance"] <= 6 and r["reference_id"] not in want for r in decided)


def test_a_hot_value_and_unreadable_ones(spark):
    batch = [(f"c{i:03}", 0, None, 0) for i in range(300)] + [(f"d{i}", 0, "not hex at all!!", None) for i in range(5)]
    c, p, j, s = dedup_tables(spark, [], batch)
    assert history_dedup.found(c, p, j, s).count() == 299
    assert history_dedup.found(c.limit(0), p.limit(0), j.limit(0), s.limit(0)).count() == 0


def test_the_stored_index_decides_batch_by_batch_like_one_pass(spark, tmp_path):
    rng = random.Random(9)
    pool = near_family(rng, 50)
    samples = [("source", hexes(rng, 64), rng.choice(pool)) for _ in range(10)]
    batch = [(f"c{i:03}", i // 40, rng.choice([None, hexes(rng, 64), samples[0][1][:20]]), rng.choice(pool)) for i in range(120)]
    c, p, j, s = dedup_tables(spark, samples, batch)
    whole = {r[0] for r in history_dedup.found(c, p, j.withColumn("created_at", F.to_timestamp(F.concat(F.lit("2026-01-0"), F.substring("job_id", 2, 1).cast("int") + 1))), s).collect()}
    open_index = lambda: history_dedup.DuplicateIndex(spark, str(tmp_path / "index"), buckets=4)
    index = open_index()
    index.accept(history_dedup.history_values(s), "samples")
    cases = set()
    values = history_dedup.batch_values(c, p, j)
    for k in range(3):
        index = open_index()
        part = values.join(c.filter(F.col("job_id") == f"j{k}").select(F.col("candidate_id").alias("id")), "id")
        out = index.check(part)
        cases |= {r["id"] for r in out.filter("not kept").collect()}
        kept = part.join(out.filter("kept").select("id"), "id")
        index.accept(kept, f"job {k}")
        index.accept(kept, f"job {k}")  # sent again
        if k == 1:
            index.compact(buckets=8, pieces=9)
            open_index().accept(kept, f"job {k}")
    assert cases == whole and index.existing().count() == 10 + 120 - len(cases)
    again = open_index()
    assert (again.buckets, again.pieces) == (8, 9) and again.check(values).filter("kept").count() == 0
    met = again.decide(values)[1]
    firsts = {(r["kind"], r["near"]): r["ref"] for r in again.references(met).collect()}
    assert firsts["d", samples[0][1]] == "s0"  # of equal members the one accepted first, also after merging


def test_a_batch_that_broke_off_does_not_count_and_is_written_over(spark, tmp_path):
    index = history_dedup.DuplicateIndex(spark, str(tmp_path / "index"), buckets=4)
    rows = spark.createDataFrame([("a", "ab" * 32, 5)], "id string, d string, h bigint")
    index.accept(rows, "one")
    index.accept(rows, "two")
    os.remove(tmp_path / "index/0/commits/two")
    assert index.existing().count() == 1
    index.accept(rows, "two")
    assert index.existing().count() == 2


def test_a_small_batch_reads_its_own_buckets_only(spark, tmp_path):
    rng = random.Random(11)
    index = history_dedup.DuplicateIndex(spark, str(tmp_path / "index"), buckets=512)
    history = spark.createDataFrame([(f"s{i}", hexes(rng, 64), signed(rng.getrandbits(64))) for i in range(400)], "id string, d string, h bigint")
    index.accept(history, "samples")

    def files_read(n):
        batch = history.limit(n).select(F.concat(F.lit("c"), "id").alias("id"), F.struct("id").alias("ord"), "d", "h")
        keys = segments.index(batch.select("h"), "h")
        stored = index._stored("segments", index._SEGMENTS, index._touched(keys))
        return stored.select(F.input_file_name()).distinct().count()

    whole = index._stored("segments", index._SEGMENTS).select(F.input_file_name()).distinct().count()
    assert files_read(1) <= 28 and files_read(4) <= 4 * 28 and whole > 500
    batch = history.limit(4).select(F.concat(F.lit("c"), "id").alias("id"), F.struct("id").alias("ord"), "d", F.col("h").bitwiseXOR(F.lit(5)).alias("h"))
    assert index.check(batch).filter("not kept").count() == 4


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_found_on_the_tables(spark):
    import pandas as pd

    s, c, p, j = (pd.read_parquet(f"{DATA}/{t}.parquet") for t in ("samples", "candidates", "provenance", "jobs"))
    import re

    dig = lambda x: m[0] if isinstance(x, str) and (m := re.fullmatch("[0-9a-f]{16,64}", re.sub("^sha256:", "", x.strip().lower()))) else None
    hsh = lambda x: int(m[0], 16) if isinstance(x, str) and (m := re.fullmatch("[0-9a-f]{1,16}", re.sub("^0x", "", x.strip().lower()))) else None
    history = [(dig(d), hsh(h)) for st, d, h in zip(s.state, s.digest, s.perceptual_hash) if st in ("source", "accepted")]
    current = c.sort_values("updated_at").drop_duplicates("candidate_id", keep="last")
    current = current[current.state == "accepted"].merge(j[["job_id", "created_at"]].rename(columns={"created_at": "at"}), on="job_id").merge(p.drop_duplicates("candidate_id")[["candidate_id", "perceptual_hash"]], on="candidate_id", how="left").sort_values(["at", "candidate_id"])
    want = greedy(history, [(i, dig(d), hsh(h)) for i, d, h in zip(current.candidate_id, current.output_digest, current.perceptual_hash)])
    got = history_dedup.found(*(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("candidates", "provenance", "jobs", "samples")))
    assert sorted(r[0] for r in got.collect()) == sorted(want) and want


# ---- problem 3 --------------------------------------------------------------------------------------------------


def overlap_tables(spark, rows):
    p = spark.createDataFrame([(i, s, d, None if h is None else f"{h:x}", T0, "clash") for i, s, d, _, h in rows], "candidate_id string, split string, source_digest string, perceptual_hash string, created_at timestamp, output string")
    return p, candidates(spark, [cand(i, dig=o) for i, _, _, o, _ in rows if i])


@pytest.mark.parametrize("tile", [3, 1000])
def test_overlaps_against_all_pairs(spark, tile):
    rng = random.Random(tile)
    pool, digests = near_family(rng, 30), [hexes(rng, 64) for _ in range(12)]
    pick = lambda: rng.choice([None, rng.choice(digests), "sha256:" + rng.choice(digests).upper(), rng.choice(digests)[:16], "junk"])
    rows = [(f"c{i:03}", rng.choice(["train", " Training ", "VAL", "test", "other", None, "testing"]), pick(), pick(), rng.choice([None, rng.choice(pool), rng.getrandbits(64)])) for i in range(160)]
    rows += [(f"hot{i}", "train" if i % 2 else "val", digests[0], None, 5) for i in range(40)]
    side = lambda s: None if s is None else {"train": "train", "training": "train", "val": "eval", "test": "eval", "testing": "eval"}.get(s.strip().lower())
    dig = lambda d: None if d in (None, "junk") else d.lower().removeprefix("sha256:")
    same = lambda a, b: bool(dig(a) and dig(b) and (dig(a).startswith(dig(b)) or dig(b).startswith(dig(a))))
    want = set()
    for a in rows:
        for b in rows:
            if side(a[1]) == "train" and side(b[1]) == "eval" and (same(a[2], b[2]) or same(a[3], b[3]) or (a[4] is not None and b[4] is not None and bin(a[4] ^ b[4]).count("1") <= 6)):
                want.add(tuple(sorted((a[0], b[0]))))
    p, c = overlap_tables(spark, rows + rows[:10])
    met = split_overlap.pairs(split_overlap.records(p, c), tile)
    got = [tuple(sorted((r["t"]["id"], r["e"]["id"]))) for r in met.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = split_overlap.report(p, c).collect()
    assert sum(r["n_pairs"] for r in report) == len(want)
    assert all(r["n_pairs"] == r["by_source"] + r["by_output"] + r["by_hash"] for r in report)


def test_minwise_hashes_are_the_lowest_rank_of_a_set():
    rng = random.Random(5)
    table, seen = minwise.ranks(20), [rng.getrandbits(64) for _ in range(30)]
    import numpy as np

    order = np.random.default_rng(minwise.SEED).permuted(np.tile(np.arange(128, dtype=np.uint8), (20, 1)), axis=1)
    want = [[min(int(order[k, 2 * i + (v >> i & 1)]) for i in range(64)) for k in range(20)] for v in seen]
    assert minwise.signatures(np.array([signed(v) for v in seen]), table).tolist() == want


@pytest.mark.parametrize("strings", [10, 10_000, 10**8])
def test_bands_miss_hardly_a_pair_at_the_limit(strings):
    import numpy as np

    rows, bands = minwise.banding(strings, 58 / 70, 1e-6)
    assert (1 - (58 / 70) ** rows) ** bands <= 1e-6
    rng = np.random.default_rng(strings)
    a = rng.integers(-(2**63), 2**63, 300)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 6, replace=False)) for _ in a], dtype=np.uint64)
    table = minwise.ranks(rows * bands)
    left, right = (minwise.signatures(x, table).reshape(len(a), bands, rows) for x in (a, (a.view(np.uint64) ^ flips).view(np.int64)))
    assert (left == right).all(-1).any(-1).all()


def test_the_report_counts_a_hot_value_without_its_pairs(spark):
    p, c = overlap_tables(spark, [(f"c{i:04}", "train" if i % 3 else "val", hexes(random.Random(i), 64) if i % 2 else None, None, 77) for i in range(3000)])
    out = split_overlap.report(p, c).collect()
    assert sum(r["n_pairs"] for r in out) == sum(r["by_hash"] for r in out) == 2000 * 1000 and sum(r["n_records"] for r in out) == 1000


def test_overlaps_of_nothing(spark):
    p, c = overlap_tables(spark, [("a", "train", None, None, None)])
    assert split_overlap.found(p, c).count() == 0 and split_overlap.found(p.limit(0), c.limit(0)).count() == 0
    assert split_overlap.report(p.limit(0), c.limit(0)).count() == 0


# ---- joins of what grows with the input -------------------------------------------------------------------------


def broadcasts(spark, run):
    """Plans with a broadcast join among those of all queries that ``run`` makes; small files look small enough for one."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    seen = store.executionsCount()
    run()
    bus.waitUntilEmpty(30_000)
    made = store.executionsList(seen, 1000)
    plans = [made.apply(i).physicalPlanDescription() for i in range(made.size())]
    assert any("SortMergeJoin" in p for p in plans)
    return [p for p in plans if "BroadcastHashJoin" in p]


def test_keys_of_hashes_are_not_sent_to_the_driver(spark):
    rng = random.Random(6)
    pool = near_family(rng, 40)
    batch = [(f"c{i:03}", rng.randrange(3), hexes(rng, 64), rng.choice(pool)) for i in range(60)]
    c, p, j, s = dedup_tables(spark, [("source", hexes(rng, 64), h) for h in pool[:10]], batch)
    for f in (history_dedup.found, history_dedup.decisions):
        assert not [x for x in broadcasts(spark, lambda f=f: f(c, p, j, s).collect()) if "job_at" not in x]  # jobs are one row a job


def test_bands_of_hashes_are_not_sent_to_the_driver(spark):
    rng = random.Random(7)
    pool = near_family(rng, 40)
    p, c = overlap_tables(spark, [(f"c{i:03}", "train" if i % 2 else "val", hexes(rng, 64), hexes(rng, 64), rng.choice(pool)) for i in range(80)])
    for f in (split_overlap.found, split_overlap.report):
        assert not broadcasts(spark, lambda f=f: f(p, c).collect())


@pytest.mark.parametrize("at_once", [1, 20_000, 10**9])
def test_bands_in_several_runs_meet_the_same_pairs(spark, at_once):
    values = sorted(set(near_family(random.Random(8), 200)))
    train, evaluation = values[::2], values[1::2]
    side = lambda some: spark.createDataFrame([(signed(v), i) for i, v in enumerate(some)], "value bigint, n bigint")
    got = [tuple(r) for r in split_overlap._hash_bands(side(train), side(evaluation), at_once).collect()]
    want = {(signed(a), signed(b), i, k) for i, a in enumerate(train) for k, b in enumerate(evaluation) if bin(a ^ b).count("1") <= 6}
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want
