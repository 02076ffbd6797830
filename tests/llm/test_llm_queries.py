"""The registered queries of the training-data operators against their SQL on the tables the driver compares, or against a check by name."""

import os
import re

import pandas as pd
import pytest

import __spark_entry__ as entry
from samplewright.llm import packing, percentile_sketch, pii

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame):
    value = lambda v: "" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(value(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return c


def texts():
    return pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id").text


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{os.environ.get('SAMPLEWRIGHT_TOKENIZERS', '/opt/tokenizers')}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    found = texts()
    return {i: e.ids for i, e in zip(found.index, t.encode_batch([x if isinstance(x, str) else "" for x in found], add_special_tokens=False), strict=True)}


def check_p5_percentiles(got, duck):
    """Ranks within the stated error, for three merged days and more: twice the error, at 99 % each."""
    runs = duck.execute("""SELECT operator, backend_id, duration_ms FROM node_runs WHERE job_id IS NOT NULL AND node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id, node_id ORDER BY attempt DESC) = 1
        AND lower(trim(status)) = 'succeeded' AND cache_hit = 0 AND duration_ms >= 0 AND backend_id IS NOT NULL AND started_at IS NOT NULL""").df()
    groups = {k: g.duration_ms.to_numpy() for k, g in runs.groupby(["operator", "backend_id"])}
    assert len(got) == len(groups)
    for r in got.to_dict("records"):
        values = groups[r["operator"], r["backend_id"]]
        assert r["n"] == len(values)
        for name in [c for c in r if re.fullmatch(r"p\d+", c)]:
            q, slack = int(name[1:]) / 100, 2 * percentile_sketch.rank_error() + 1 / len(values)
            assert (values < r[name]).mean() - slack <= q <= (values <= r[name]).mean() + slack, (r, name)


def check_p6_ids(got, duck):
    want = library()
    assert len(got) == len(want) and all(list(r.ids) == want[r.doc_id] for r in got.itertuples())


def check_p7_packing(got, duck):
    tokens = {i: len(x) for i, x in library().items()}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == tokens
    used = got.groupby("container_id").n_tokens.sum()
    assert used.max() <= packing.CAPACITY and len(used) <= -(-sum(tokens.values()) // packing.CAPACITY) + 2
    assert (got.groupby("doc_id").part.max()[[i for i, n in tokens.items() if n <= packing.CAPACITY]] == 0).all()


def check_p7_fill(got, duck):
    r = got.iloc[0]
    assert r.tokens == sum(map(len, library().values())) and r.fullest <= packing.CAPACITY and abs(r.fill - r.tokens / r.containers / packing.CAPACITY) < 1e-6 and r.containers <= -(-r.tokens // packing.CAPACITY) + 2


def check_p8_found(got, duck):
    found = texts()
    assert set(got.kind) == set(pii.KINDS) and len(got) > 500
    for r in got.itertuples():
        place = found[r.doc_id][r.start_pos : r.end_pos]
        assert place == place.strip() and pii.check(found[r.doc_id], r.start_pos, r.end_pos, r.kind)


def check_p8_redacted(got, duck):
    found, count = texts(), r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|PERSON)\]"
    assert len(got) == len(found)
    for r in got.itertuples():
        if not isinstance(found[r.doc_id], str):
            assert r.text is None or r.text != r.text
        elif not r.n_places:
            assert r.text == found[r.doc_id]
        else:
            kept = [re.escape(x) for x in re.split(count, r.text)]
            assert len(kept) >= r.n_places + 1 and re.fullmatch(".+?".join(kept), found[r.doc_id], re.DOTALL)


CHECKS = {f.__name__.removeprefix("check_"): f for f in (check_p5_percentiles, check_p6_ids, check_p7_packing, check_p7_fill, check_p8_found, check_p8_redacted)}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if re.match(r"p\d_", n)))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        CHECKS[name](got, duck)
        return
    want = duck.execute(sql).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)
