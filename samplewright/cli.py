"""Command line: thin wrappers over the library. Exit code 0: done, 1: the job or check failed, 2: wrong use or configuration.

    python -m samplewright.cli inspect FOLDER
    python -m samplewright.cli recipe RECIPE.yaml            check and hash
    python -m samplewright.cli plan RECIPE.yaml --samples N  rows, seconds and cost of each stage
    python -m samplewright.cli run RECIPE.yaml --out DIR
    python -m samplewright.cli qa DIR RECIPE.yaml            apply a policy to stored evidence
    python -m samplewright.cli report DIR
    python -m samplewright.cli export DIR RECIPE.yaml --out DIR [--reviews FILE.csv]
    python -m samplewright.cli workflow RECIPE.yaml
    python -m samplewright.cli video SPEC.json
    python -m samplewright.cli jobs TABLES
"""

from __future__ import annotations

import argparse
import json
import sys

from samplewright.operators import gates, report, video
from samplewright.plans import recipe as recipes
from samplewright.plans import stages
from samplewright.session import release, settle


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def show(df) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def inspect(a) -> int:
    from samplewright.sources import images

    found = images.discover(session(), a.folder)
    show(found.groupBy("kind", "reason").count())
    show(found.filter("reason is null").groupBy("width", "height").count())
    return 0


def recipe(a) -> int:
    print(recipes.load_file(a.recipe).hash)
    return 0


def _plan(r: recipes.Recipe) -> stages.StagePlan:
    return stages.StagePlan(r.target.max_per_sample, r.replacement.candidates_per_object)


_BOUND = {"detect.objects": "builtin_detector", "segment.target": "builtin_segmenter", "scene.analyse": "builtin_scene", "plan.replacement": "builtin_planner", "generate.replacement": "builtin_replacement", "refine.candidate": "builtin_refiner", "verify.redetect": "builtin_detector", "evaluate.candidate": "builtin_metrics"}


def plan(a) -> int:
    print(json.dumps(_plan(recipes.load_file(a.recipe)).estimate(a.samples, _BOUND), indent=1))
    return 0


def workflow(a) -> int:
    print(json.dumps(stages.document(_plan(recipes.load_file(a.recipe))), indent=1))
    return 0


def run(a) -> int:
    from pyspark.sql import functions as F

    from samplewright.plans import pipeline
    from samplewright.sources import images, labels

    r = recipes.load_file(a.recipe)
    spark = session()
    good, refused = images.ingest(images.with_split(images.discover(spark, r.dataset.path, r.dataset.recursive), r.dataset.split_mode, r.dataset.path))
    good.select(F.col("relative_path").alias("id"), F.col("digest").alias("root"), "split").write.mode("overwrite").parquet(f"{a.out}/samples")
    allowed = sorted({"val" if s in ("validation", "valid") else s for s in r.dataset.augment_splits})
    good = good.filter(F.col("split").isin(*allowed))
    if good.isEmpty():
        refused.write.mode("overwrite").parquet(f"{a.out}/refused")
        raise RuntimeError(f"no sample of {r.dataset.path} stands in a split to augment: {', '.join(allowed)}")
    source = None if r.dataset.annotations == "none" else labels.of_samples(good, r.dataset.annotations, r.dataset.path)
    usable, unread = images.readable(good, r.dataset.path, r.dataset.max_samples)
    refused = refused.unionByName(unread)
    refused.write.mode("overwrite").parquet(f"{a.out}/refused")
    show(refused.groupBy("error_code", "reason").count())
    if usable.isEmpty():
        raise RuntimeError(f"no sample of {r.dataset.path} can be read; see {a.out}/refused")
    job = pipeline.run(usable, r)
    for name in ("detections", "targets", "segments", "decided"):
        job[name].write.mode("overwrite").parquet(f"{a.out}/{name}")
    # Labels of every candidate: a review may still accept it.
    pipeline.labels(job, ("accepted", "needs_review", "rejected"), source).write.mode("overwrite").parquet(f"{a.out}/labels")
    if r.duplicates.algorithm != "none":
        for name, rows in zip(("hashes", "source_hashes"), pipeline.hashes(job, r.duplicates.algorithm), strict=True):
            rows.withColumn("algorithm", F.lit(r.duplicates.algorithm)).write.mode("overwrite").parquet(f"{a.out}/{name}")
    show(gates.acceptance(spark.read.parquet(f"{a.out}/decided"), ["category"]))
    return 0


def _evidence(a):
    decided = session().read.parquet(f"{a.folder}/decided")
    return decided.drop("overall", "failed_gates", "borderline_gates", "warned_gates", "missing_gates", "reason_codes", "policy_hash")


def qa(a) -> int:
    old = _evidence(a).withColumnRenamed("decision", "old_decision")
    new = gates.decide(old, recipes.load_file(a.recipe).policy())
    show(new.groupBy("old_decision", "decision").count())
    return 0


def report_(a) -> int:
    decided = session().read.parquet(f"{a.folder}/decided")
    show(gates.acceptance(decided, ["category"]))
    show(gates.reason_histogram(decided))
    return 0


def export(a) -> int:
    from pyspark.sql import functions as F

    from samplewright.operators import export as out

    r = recipes.load_file(a.recipe)
    spark = session()
    decided = spark.read.parquet(f"{a.folder}/decided")
    if a.reviews:
        decided = out.review_override(decided, spark.read.csv(a.reviews, header=True))
    states = ("accepted", "needs_review") if r.export.include_review else ("accepted",)
    decided = decided.filter(F.col("decision").isin(*states))
    problems = out.lineage_problems(decided, spark.read.parquet(f"{a.folder}/samples"))
    dropped = 0
    if r.duplicates.algorithm != "none":
        hashes, sources = (spark.read.parquet(f"{a.folder}/{n}") for n in ("hashes", "source_hashes"))
        if not hashes.filter(F.col("algorithm") != r.duplicates.algorithm).isEmpty():
            raise out.ExportError(f"the job's images were not hashed by {r.duplicates.algorithm}")
        decided, decisions = out.exportable(decided, hashes, sources, r.duplicates.threshold, states)
        duplicates = settle(decisions.filter("not kept"), "export-duplicates")
        dropped = duplicates.count()
    splits = spark.read.parquet(f"{a.folder}/samples").groupBy(F.col("id").alias("sample_id")).agg(F.min("split").alias("split"))
    sizes = decided.join(splits, "sample_id", "left").select(F.col("candidate_id").alias("image"), F.coalesce("split", F.lit("train")).alias("split"), F.col("width").cast("double").alias("image_width"), F.col("height").cast("double").alias("image_height"))
    labels = spark.read.parquet(f"{a.folder}/labels").join(sizes, "image")
    rows = out.provenance(decided, spark.read.parquet(f"{a.folder}/targets"), {"recipe": r.hash, "recipe_name": r.name})
    bound = {"image.replacement.v1": {"id": "builtin_replacement", "demo_only": True}}
    print(json.dumps(out.export(rows, labels, a.out, {"recipe": r.hash, "duplicates": dropped}, r.export.format, bound, r.allow_demo_backends, problems)))
    if r.duplicates.algorithm != "none":
        duplicates.write.mode("overwrite").parquet(f"{a.out}/duplicates")
    return 0


def video_(a) -> int:
    with open(a.spec, encoding="utf-8") as f:
        doc = json.load(f)
    spec = video.Spec(doc["id"], doc.get("seed", 0), doc.get("strategy", "paired"), doc.get("max_variants", 16), doc.get("max_active_ops"), tuple(video.Operator(o["name"], o["axis"], o["domains"]) for o in doc["operators"]))
    rows = video.variants(session(), spec)
    show(rows)
    show(video.contrast_pairs(rows))
    return 0


def jobs(a) -> int:
    show(report.job_counters(session().read.parquet(f"{a.tables}/node_runs.parquet")))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="samplewright")
    sub = parser.add_subparsers(dest="command", required=True)
    commands = {"inspect": (inspect, "folder"), "recipe": (recipe, "recipe"), "plan": (plan, "recipe"), "run": (run, "recipe"), "qa": (qa, "folder", "recipe"), "report": (report_, "folder"), "export": (export, "folder", "recipe"), "workflow": (workflow, "recipe"), "video": (video_, "spec"), "jobs": (jobs, "tables")}
    for name, (call, *places) in commands.items():
        p = sub.add_parser(name)
        p.set_defaults(call=call)
        for place in places:
            p.add_argument(place)
        if name == "plan":
            p.add_argument("--samples", type=int, default=1)
        if name in ("run", "export"):
            p.add_argument("--out", required=True)
        if name == "export":
            p.add_argument("--reviews", help="CSV of candidate_id, decision that replace the machine's")
    try:
        a = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        code = a.call(a)
        if a.command in ("run", "export"):
            release(session())  # what was settled on the way; the results are written
        return code
    except (recipes.RecipeError, FileNotFoundError, KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except RuntimeError as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
