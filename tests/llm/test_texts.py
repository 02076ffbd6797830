"""Operators on texts: exact round trips, invariants, and held-out accuracy."""

import os
import random

import numpy as np
import pytest

from samplewright.llm import bpe, packing, pii, pii_train

DATA = "/root/testdata/sf0.01/documents.parquet"
VOCABULARY = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files")
ODD = [None, "", " ", "\n\n\r\n  x", "a" * 5000, "aaaa aaaaa", "é" * 700, "ab" * 3000, "!!!!!!!!" * 40, "<|endoftext|>", "日本語テスト 中文。", "👩🏽‍🔧🚧 x", "it's we'll I'd", "  mixed\tspace ", "١٢٣ 123", "﻿x​"]


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "len", 5) for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id bigint, text string, kind string, n_tokens int")


# ---- problem 6 --------------------------------------------------------------------------------------------------


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@needs_vocabulary
def test_ids_equal_the_librarys(spark):
    rng = random.Random(1)
    noise = ["".join(rng.choice("aab  \n.'s1é中") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts = ODD + noise
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == library(texts)


@needs_vocabulary
def test_repeated_ids_and_no_rows(spark):
    out = bpe.encode_corpus(documents(spark, ["a b", "a b", None], [1, 1, None])).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in out) == [(0, []), (1, [64, 275]), (1, [64, 275])]
    assert bpe.encode_corpus(documents(spark, [])).count() == 0


@needs_vocabulary
def test_memory_is_forgotten_without_changing_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    e = bpe.PairIndexEncoder(VOCABULARY)
    for text in ("one two three four", "five six one two", "three"):
        ids, offsets = e.encode([text])
        assert ids.tolist() == library([text])[0] and offsets.tolist() == [0, len(ids)]


@needs_vocabulary
@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_ids_of_the_table(spark):
    df = spark.read.parquet(DATA)
    rows = df.select("doc_id", "text").toPandas()
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df).collect()}
    assert [got[i] for i in rows.doc_id] == library([t if isinstance(t, str) else None for t in rows.text])


# ---- problem 7 --------------------------------------------------------------------------------------------------


def placed(spark, sizes, capacity=64, **more):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, container_id string")
    return packing.pack(df, capacity, **more).toPandas()


def check_packing(out, sizes, capacity):
    by_doc = out.groupby("doc_id")
    assert sorted(by_doc.groups) == list(range(len(sizes)))
    for doc, rows in by_doc:
        rows = rows.sort_values("part")
        assert rows.n_tokens.sum() == sizes[doc] and rows.part.tolist() == list(range(len(rows)))
        assert rows.start_token.tolist() == [p * capacity for p in rows.part]
        assert len(rows) == max(1, -(-sizes[doc] // capacity))  # cut only if longer than a container
    for _, rows in out[out.n_tokens > 0].groupby("container_id"):
        rows = rows.sort_values("at_token")
        ends = (rows.at_token + rows.n_tokens).tolist()
        assert rows.at_token.iloc[0] == 0 and rows.at_token.iloc[1:].tolist() == ends[:-1] and ends[-1] <= capacity


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_whole_and_tight(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 7, 33, 64, rng.randint(1, 64), rng.randint(1, 20), rng.randint(65, 400)]) for _ in range(1500)]
    out = placed(spark, sizes, chunk=40)
    check_packing(out, sizes, 64)
    used = out[out.n_tokens > 0].container_id.nunique()
    gaps: list[int] = []  # best-fit decreasing, one item at a time
    for size in sorted((n for x in sizes for n in [64] * (x // 64) + [x % 64] if n), reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 64) - size)
    assert used == out.container_id.max() + 1 and used <= len(gaps) + 1
    assert placed(spark, sizes, chunk=40).sort_values(["doc_id", "part"]).values.tolist() == out.sort_values(["doc_id", "part"]).values.tolist()


def test_packing_of_one_length_of_empties_and_of_nothing(spark):
    out = placed(spark, [40] * 500, chunk=20)
    check_packing(out, [40] * 500, 64)
    assert out.container_id.nunique() == 500 and placed(spark, []).empty
    assert set(placed(spark, [0, 0, 0]).container_id) == {0}


def test_step_groups_weigh_the_same(spark):
    rng = random.Random(7)
    sizes = [rng.randint(1, 60) for _ in range(4000)]
    out = placed(spark, sizes, per_step=8)
    cost = (out.n_tokens.astype(float) ** 2).groupby(out.step_group).sum()
    full = out.groupby("step_group").container_id.nunique()
    cost = cost[full == 8]
    in_order = (out.n_tokens.astype(float) ** 2).groupby(out.container_id // 8).sum().iloc[:-1]
    assert full.max() <= 8 and cost.max() / cost.min() < 1.2 < in_order.max() / in_order.min()


def test_tiers_shape_the_plan(spark):
    rng = random.Random(3)
    sizes = [rng.choice([rng.randint(33, 64), rng.randint(9, 32), rng.randint(1, 8)]) for _ in range(3000)]
    histogram = {n: sizes.count(n) for n in set(sizes)}
    tiered, flat = packing.plan(histogram, 64), packing.plan(histogram, 64, [64])
    assert tiered[0].tolist() != flat[0].tolist() and abs(tiered[1] - flat[1]) <= 1 + flat[1] // 200
    out = placed(spark, sizes, 64)
    check_packing(out, sizes, 64)
    assert set(out.window) > {64, 32} and (out.n_tokens <= out.window).all()
    inside = out.at_token % out.window + out.n_tokens  # nothing crosses the end of its window
    assert (inside <= out.window).all()
    short = out[out.window < 64]
    filled = short.assign(at=short.at_token // short.window).groupby(["container_id", "at"]).agg(used=("n_tokens", "sum"), window=("window", "max"))
    assert (filled.used == filled.window).all()  # sealed windows are full


def test_slots_are_bounded_by_the_capacity():
    rng = random.Random(2)
    few, many = ({x: rng.randint(1, 9) * k for x in range(1, 2049)} for k in (1, 100_000))
    slots, containers = packing.plan(many)
    assert len(slots) < 40 * 2048 and sum(n * x for x, n in many.items()) / (containers * 2048) > 0.99
    assert packing.plan(few)[1] > 0 and packing.plan({}) [1] == 0


@needs_vocabulary
def test_documents_are_packed_by_their_tokens(spark):
    texts = ODD * 3
    out = packing.pack_documents(documents(spark, texts), 256).toPandas()
    check_packing(out, [len(x) for x in library(texts)], 256)


# ---- problem 8 --------------------------------------------------------------------------------------------------


def spots(text):
    return {(text[s:e], k) for s, e, k in pii.places([text])[0]}


def test_places_of_each_kind():
    text = "Consent form of Mirela-Amparo Dunvález, identity number QQ939180A, is attached.\nWrite to vera.lindqvist (at) post (dot) example or ring +44 20 7946 0017, not both.\nReturn the disk to K. Ostrik, 12 Larchmere Street, Apt 4B, Eastfenn 00417."
    assert spots(text) == {("Mirela-Amparo Dunvález", "person"), ("QQ939180A", "id_number"), ("vera.lindqvist (at) post (dot) example", "email"), ("+44 20 7946 0017", "phone"), ("K. Ostrik", "person"), ("12 Larchmere Street, Apt 4B, Eastfenn 00417", "address")}


def test_numbers_and_names_of_things_are_no_places():
    assert pii.places(["Ticket 555-237-82 was merged into batch@1ad0. img_6@2x.png was skipped. The Mill Street set has 5 frames, the Harbour Road set 949.\nBackend builtin_metrics answered at 10.0.7.790 with status 503. Timing 54.5.3.81 / 369-470 / 0x67a1d07c4f4b3296", None, "", " "]) == [[], [], [], []]


def test_long_texts_and_window_edges():
    """A place stands where it is, whatever the windows' edges cut."""
    line, name = "The night shift kept every mailbox in the set without a reason code. ", "Second opinion from Imke Ruskast; her mobile is 202-555-0147. "
    for shift in range(0, 170, 7):
        text = line[: shift % len(line)] + line * (shift // len(line)) + line + name + line * 3
        assert spots(text) == {("Imke Ruskast", "person"), ("202-555-0147", "phone")}, shift
    long = line * 3000 + name + line * 2000
    found = pii.places([long])[0]
    assert {long[s:e] for s, e, _ in found} == {"Imke Ruskast", "202-555-0147"}


def test_a_place_is_grown_to_its_token_however_long():
    mail = "a" + "b.c" * 100 + "@mail." + "example" * 40
    text = f"Write to {mail}, please."
    start = text.index(mail)
    assert pii.check(text, start + 250, start + 310, "email") == (start, start + len(mail))


def test_find_and_redact_on_tables(spark):
    text = "👩🏽‍🔧 Reviewed by Zoë Tovard on 2026-01-02.\r\nMail bounced: a.b@example.org, try c_d@example.net instead."
    df = documents(spark, [text, None, "", "nothing here", text], [3, 4, 5, 6, 3])
    rows = pii.find(df).collect()
    assert sorted((r["doc_id"], text[r["start_pos"] : r["end_pos"]], r["kind"]) for r in rows) == sorted([(3, "Zoë Tovard", "person"), (3, "a.b@example.org", "email"), (3, "c_d@example.net", "email")] * 2)
    out = [(r["doc_id"], r["text"], r["n_places"]) for r in pii.redact(df).orderBy("doc_id").collect()]
    clean = "👩🏽‍🔧 Reviewed by [PERSON] on 2026-01-02.\r\nMail bounced: [EMAIL], try [EMAIL] instead."
    assert out == [(3, clean, 3), (3, clean, 3), (4, None, 0), (5, "", 0), (6, "nothing here", 0)]
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_hand_written_sentences():
    """Names, numbers and addresses of ordinary life, which the tables do not hold; the README has the figures by kind."""
    import held_out

    hit = found = true = 0
    for text, want in held_out.cases():
        got = set(pii.places([text])[0])
        hit, found, true = hit + len(got & want), found + len(got), true + len(want)
    assert true == 57 and hit / true > 0.7 and hit / found > 0.8


def test_names_in_han_characters_and_made_up_passages():
    from collections import Counter

    from samplewright.llm import pii_texts

    assert ("王小明", "person") in spots("请联系王小明，电话13912345678。")
    rng, hit, found, true = random.Random(99), Counter(), Counter(), Counter()
    for text, want in (pii_texts.passage(rng) for _ in range(300)):
        got = set(pii.places([text])[0])
        for count, some in ((hit, got & set(want)), (found, got), (true, want)):
            count.update(k for *_, k in some)
    assert set(true) == set(pii.KINDS) and all(hit[k] > 0.98 * max(found[k], true[k]) for k in true)


def test_decoding_against_all_paths():
    """Viterbi with the shortcut for windows without places equals the best of all tag sequences."""
    import itertools

    model = pii.tagger()
    rng = np.random.default_rng(3)
    for scale in (1.0, 6.0):
        scores = rng.normal(0, scale, (4, 6, len(pii.TAGS))).astype(np.float32)
        scores[:, 3:, 0] += 30
        tags = model.decode(scores)
        for w in (0, 3):
            value = lambda p: scores[range(4), w, p].sum() + model.first[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            best = max((list(p) for p in itertools.product(range(len(pii.TAGS)), repeat=4)), key=value)
            assert tags[:, w].tolist() == best


def test_training_gradient(monkeypatch):
    monkeypatch.setattr(pii_train, "HIDDEN", 5)
    monkeypatch.setattr(pii_train, "EMBED", 4)
    w = {k: v if k == "han" else v.astype(np.float64) for k, v in pii_train.initial("").items()}
    r = np.random.default_rng(1)
    codes, tags = r.integers(0, 60, (7, 3)), np.zeros((7, 3), int)
    tags[2:5, 1] = 1, 2, 2
    _, grad = pii_train.gradient(w, codes, tags)
    for k in ("e", "u_f", "u_b", "w_f", "b_b", "o", "c", "t", "s"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        sides = []
        for step in (1e-3, -2e-3):
            w[k][at] += step
            sides.append(pii_train.gradient(w, codes, tags)[0])
        w[k][at] += 1e-3
        assert abs((sides[0] - sides[1]) / 2e-3 - grad[k][at]) < 1e-3 * max(0.01, abs(grad[k][at]))


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_accuracy_on_documents_outside_the_training_tables():
    import pandas as pd

    texts = [t for t in pd.read_parquet(DATA).text if isinstance(t, str) and t]
    with np.load(pii.WEIGHTS) as f:
        got = pii_train.score({k: f[k] for k in f.files}, texts)
    assert all(p > 0.97 and r > 0.97 for p, r in got.values()), got
