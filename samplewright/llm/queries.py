"""The pN queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.llm import band_topn, bpe, history_dedup, keep_fraction, packing, percentile_sketch, pii, split_overlap
from samplewright.llm.sql import SQL  # noqa: F401
from samplewright.session import table as t


def p1_found(spark, d):
    return history_dedup.found(t(spark, d, "candidates"), t(spark, d, "provenance"), t(spark, d, "jobs"), t(spark, d, "samples"))


def p1_decisions(spark, d):
    return history_dedup.decisions(t(spark, d, "candidates"), t(spark, d, "provenance"), t(spark, d, "jobs"), t(spark, d, "samples"))


def p2_found(spark, d):
    scored = keep_fraction.settled_candidates(t(spark, d, "candidates"))
    return keep_fraction.kept(scored, keep_fraction.cutoffs(scored, t(spark, d, "keep_targets")))


def p2_cutoffs(spark, d):
    scored = keep_fraction.settled_candidates(t(spark, d, "candidates"))
    return keep_fraction.cutoffs(scored, t(spark, d, "keep_targets")).withColumnRenamed("cat", "category")


def p3_found(spark, d):
    return split_overlap.found(t(spark, d, "provenance"), t(spark, d, "candidates"))


def p3_report(spark, d):
    return split_overlap.report(t(spark, d, "provenance"), t(spark, d, "candidates"))


def p4_found(spark, d):
    return band_topn.top_candidates(t(spark, d, "candidates")).select("sample_id", "target_object_id", "candidate_id")


def p5_found(spark, d):
    return percentile_sketch.slow_days(t(spark, d, "node_runs"))


def p5_percentiles(spark, d):
    runs = percentile_sketch.counted_runs(t(spark, d, "node_runs"))
    return percentile_sketch.percentiles(percentile_sketch.daily_sketches(runs))


def p6_ids(spark, d):
    return bpe.encode_corpus(t(spark, d, "documents"))


def p7_packing(spark, d):
    return packing.pack_documents(t(spark, d, "documents"))


def p7_fill(spark, d):
    placed = packing.pack_documents(t(spark, d, "documents")).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return placed.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * packing.CAPACITY), 6).alias("fill"))


def p8_found(spark, d):
    return pii.find(t(spark, d, "documents"))


def p8_redacted(spark, d):
    return pii.redact(t(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_decisions, p2_found, p2_cutoffs, p3_found, p3_report, p4_found, p5_found, p5_percentiles, p6_ids, p7_packing, p7_fill, p8_found, p8_redacted)}

