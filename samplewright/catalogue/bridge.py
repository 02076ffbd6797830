"""Stand-ins for image data: detections, evidence and rasters derived from the test tables.

Each relation has the same definition in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.session import table

KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

DETECTIONS_SQL = f"""det AS (SELECT l_orderkey AS sample_id, {KEY} AS object_id, l_returnflag AS class_name, l_partkey AS part_key,
  round(1 - l_discount * 4, 4) AS score, CAST(l_partkey % 600 AS DOUBLE) AS x_min, CAST(l_suppkey % 400 AS DOUBLE) AS y_min,
  CAST(l_partkey % 600 + 8 + l_quantity * 4 AS DOUBLE) AS x_max, CAST(l_suppkey % 400 + 8 + (l_partkey % 50) * 4 AS DOUBLE) AS y_max,
  CAST((8 + l_quantity * 4) * (8 + (l_partkey % 50) * 4) AS BIGINT) AS area, 800.0::DOUBLE AS image_width, 600.0::DOUBLE AS image_height FROM lineitem)"""

METRICS = ["semantic_match", "target_presence", "background_preservation", "mask_boundary", "geometry", "artifact_free", "annotation_consistency"]
EVIDENCE_SQL = f"""cand AS (SELECT {KEY} AS candidate_id, l_returnflag AS category, 1 - l_discount AS semantic_match, least(0.5 + l_quantity / 40, 1.0) AS target_presence, 1 - l_tax AS background_preservation,
  CASE WHEN l_linenumber = 4 THEN NULL ELSE 0.4 + l_quantity / 80 END AS mask_boundary, 1 - l_discount * l_tax * 20 AS geometry, CASE WHEN l_quantity = 50 THEN NULL ELSE 1 - l_tax * l_quantity / 25 END AS artifact_free,
  CASE WHEN l_quantity < 3 THEN NULL ELSE l_quantity / 50 END AS annotation_consistency FROM lineitem)"""


def detections(spark, d):
    expr = DETECTIONS_SQL.split("(SELECT ", 1)[1].rsplit(" FROM lineitem", 1)[0]
    expr = expr.replace("800.0::DOUBLE", "CAST(800 AS DOUBLE)").replace("600.0::DOUBLE", "CAST(600 AS DOUBLE)")
    return table(spark, d, "lineitem").selectExpr(*_columns(expr))


def evidence(spark, d):
    expr = EVIDENCE_SQL.split("(SELECT ", 1)[1].rsplit(" FROM lineitem", 1)[0]
    return table(spark, d, "lineitem").selectExpr(*_columns(expr))


def long_evidence(spark, d):
    """Rows ``candidate_id, category, metric, value``."""
    return evidence(spark, d).unpivot(["candidate_id", "category"], METRICS, "metric", "value")


def rasters(spark, d):
    """8 x 8 grey rasters: ``id, label, pixels``."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("pixels"))


def _columns(text: str) -> list[str]:
    """Split a select list at its outer commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]
