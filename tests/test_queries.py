"""Every registered query against its SQL on the tables the driver compares, or against a check by name.

Those of the training-data operators stand in tests/llm.
"""

import os
import re

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame):
    names = sorted(frame.columns)
    value = lambda v: "" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(value(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return c


def blocks():
    """Place, width and height of the block in each synthetic picture."""
    vectors = pd.read_parquet(f"{DATA}/embeddings.parquet")
    v = np.abs(np.array(vectors.embedding.tolist(), dtype=float))
    part = lambda i, add, most: add + (v[:, i] * 40).astype(int) % most
    return pd.DataFrame({"id": vectors.vec_id, "label": vectors.label, "x": part(0, 5, 15), "y": part(1, 4, 10), "w": part(2, 8, 8), "h": part(3, 7, 6)})


def check_raster_metrics(got):
    rows = got.merge(blocks(), on="id")
    first = rows.loc[rows.groupby("label").id.idxmin()]  # measured against itself
    assert len(rows) == len(got) and (first.ssim > 1 - 1e-6).all() and (first.changed_ratio == 0).all() and (first.mask_iou == 1).all() and (first.centroid_shift == 0).all()
    shares = [c for c in got.columns if c in ("ssim", "changed_ratio", "perceptual_delta", "seam", "gradient_gap", "component_ratio", "floating", "edge_density", "text_like", "mask_iou", "coverage")]
    assert len(shares) == 11 and ((got[shares] >= 0) & (got[shares] <= 1)).all(axis=None) and (got.mean_delta >= 0).all()


def check_pipeline_decisions(got):
    assert len(got) == 2 * len(blocks()) and got.candidate_id.is_unique and set(got.category) == {"sedan", "taxi"}
    assert got.overall.between(0, 1).all() and set(got.decision) <= {"accepted", "rejected", "needs_review"}
    assert (got.overall[got.decision == "accepted"] >= 0.5 - 1e-6).all() and (got.codes[got.decision == "rejected"] != "").all() and (got.decision == "accepted").any()


def check_segment_targets(got):
    rows = got.assign(id=got.object_id.str[1:].astype(int)).merge(blocks(), on="id")
    assert len(rows) == len(blocks()) and rows.error_code.isna().all() and (rows.area == rows.w * rows.h).all() and (rows.points == 4).all()


def check_scene_analysis(got):
    rows = got.assign(id=got.sample_id.astype(int)).merge(blocks(), on="id")
    # The detector's opening takes a block's corners. Around it is a ramp from 0.41 to 0.49.
    assert len(rows) == len(blocks()) and np.allclose(rows.coverage, (rows.w * rows.h - 4) / 1200, atol=1e-6) and rows.luminance.between(0.41, 0.49).all() and (rows.contrast < 0.05).all() and (rows.background == "a flat mid-tone background").all()


CHECKS = {"raster_metrics": check_raster_metrics, "pipeline_decisions": check_pipeline_decisions, "segment_targets": check_segment_targets, "scene_analysis": check_scene_analysis}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not re.match(r"p\d_", n)))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        CHECKS[name](got)
        return
    want = duck.execute(sql).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
