"""The verified dataset: what is exported, what is refused, and its manifest and provenance."""

from __future__ import annotations

import hashlib
import json
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.operators import dedup, lineage
from samplewright.plans import guard
from samplewright.sources import labels as formats


class ExportError(RuntimeError):
    """An export that may not be written."""


def review_override(decided: DataFrame, reviews: DataFrame) -> DataFrame:
    """Decisions of reviewers (``candidate_id, decision``) in place of the machine's; the latter stays in ``machine_decision``."""
    named = reviews.groupBy("candidate_id").agg(F.max("decision").alias("__r"))
    return decided.withColumnRenamed("decision", "machine_decision").join(named, "candidate_id", "left").withColumn("decision", F.coalesce("__r", "machine_decision")).drop("__r")


def exportable(decided: DataFrame, hashes: DataFrame, references: DataFrame | None = None, threshold: int = 6, states: tuple[str, ...] = ("accepted",)) -> tuple[DataFrame, DataFrame]:
    """Candidates of the given decisions without duplicates, and the duplicate decisions.

    ``hashes`` has ``candidate_id, ord, hash`` of the produced images, ``references`` has ``item, hash`` of the sources.
    """
    accepted = decided.filter(F.col("decision").isin(*states))
    records = accepted.select("candidate_id").join(hashes, "candidate_id", "left").select(F.col("candidate_id").alias("item"), "ord", "hash")
    decisions = dedup.resolve(records, references, threshold)
    dropped = decisions.filter("not kept").select(F.col("item").alias("candidate_id"))
    return accepted.join(dropped, "candidate_id", "left_anti"), decisions


def leaks(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Lineage edges across splits and roots in several splits, as one list of problems."""
    crossed = lineage.split_leaks(edges, samples).select(F.lit("edge").alias("kind"), "child", "parent")
    roots = lineage.roots_in_many_splits(samples.select(F.col("root"), "split")).select(F.lit("root").alias("kind"), F.col("root").alias("child"), F.lit(None).cast("string").alias("parent"))
    return crossed.unionByName(roots)


def lineage_problems(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """:func:`leaks` of candidates ``candidate_id, sample_id`` and every sample ``id, root, split`` that shares a root with them."""
    made = candidates.select(F.col("candidate_id").alias("child"), F.col("sample_id").alias("parent"))
    roots = samples.join(made.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").select("root").distinct()
    related = samples.join(roots, "root", "left_semi").select("id", "root", "split")
    heirs = made.join(related.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("id"), "root", "split")
    return leaks(made, related.unionByName(heirs))


def provenance(decided: DataFrame, targets: DataFrame, job: dict) -> DataFrame:
    """The record of each exported candidate: where it comes from and what decided it."""
    return decided.join(targets.select("sample_id", "object_id", F.col("class_name").alias("target_class")), ["sample_id", "object_id"], "left").select(
        "candidate_id", F.col("sample_id").alias("source_sample_id"), F.col("object_id").alias("target_object_id"), "target_class", F.col("category").alias("replacement_category"), "decision", "overall", "reason_codes", *[F.lit(str(v)).alias(k) for k, v in sorted(job.items())]
    )


def export(rows: DataFrame, labels: DataFrame, folder: str, job: dict, form: str = "coco", bindings: dict | None = None, allow_demo: bool = False, problems: DataFrame | None = None) -> dict:
    """Write labels, provenance and manifest; refuse on leakage, demo backends and secrets. Returns the manifest."""
    if (blocked := guard.demo_backends(bindings or {}, allow_demo)):
        raise ExportError("; ".join(blocked))
    if (secrets := guard.secret_places(job)):
        raise ExportError(f"the manifest would hold secrets at {', '.join(secrets)}")
    if problems is not None and not problems.isEmpty():
        raise ExportError("samples of one lineage stand in several splits")
    rows.write.mode("overwrite").parquet(f"{folder}/provenance")
    (formats.write_coco if form == "coco" else formats.write_yolo)(labels, f"{folder}/{form}")
    counts = rows.agg(F.count("*").alias("n"), F.countDistinct("source_sample_id").alias("sources")).first()
    manifest = {"format": form, "exported": counts["n"], "sources": counts["sources"], "job": job}
    manifest["digest"] = hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    rows.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def review_page(decided: DataFrame, most: int = 200) -> str:
    """A static page of the candidates to look at, worst first: a report of the top ``most``."""
    rows = decided.filter("decision = 'needs_review'").orderBy("overall", "candidate_id").limit(most).collect()
    cells = "".join(f"<tr><td>{escape(str(r['candidate_id']))}</td><td>{escape(str(r['category']))}</td><td>{r['overall']:.4f}</td><td>{escape(', '.join(r['reason_codes']))}</td></tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>Review</title><table><tr><th>candidate<th>category<th>overall<th>reasons</tr>{cells}</table>"
