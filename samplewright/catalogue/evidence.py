"""Gates, decisions, outcomes and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.catalogue.bridge import EVIDENCE_SQL, METRICS, evidence, long_evidence
from samplewright.operators import gates, outcomes, report
from samplewright.session import table

_G = gates.Gate


def _policy(minimum, band, allow, semantic, annotation):
    return gates.Policy(minimum, band, allow, (_G("semantic_match", semantic), _G("target_presence", 0.6), _G("background_preservation", 0.94), _G("mask_boundary", 0.5, "warn"), _G("geometry", 0.92), _G("artifact_free", 0.9, "warn"), _G("annotation_consistency", annotation, "warn")))


POLICY = _policy(0.85, 0.03, True, 0.95, 0.20)
LOOSER = _policy(0.80, 0.03, True, 0.92, 0.10)
STRICT = _policy(0.85, 0.0, False, 0.95, 0.20)


def _decided(spark, d, policy=POLICY):
    return gates.decide(evidence(spark, d), policy)


def _decide_sql(minimum, band, semantic, annotation, suffix="", missing=False):
    """The policy in SQL, independent of the operator: overall, the state of each gate, the decision and the codes in their order."""
    d = lambda x: f"{x}::DOUBLE"
    weight = dict(zip(METRICS, (0.24, 0.16, 0.22, 0.10, 0.12, 0.10, 0.06)))
    reason = dict(zip(METRICS, ("SEMANTIC_MISMATCH", "OBJECT_NOT_FOUND", "BACKGROUND_CHANGED", "MASK_BOUNDARY_ARTIFACT", "GEOMETRY_VIOLATION", "ARTIFACT_DETECTED", "ANNOTATION_MISMATCH")))
    least = dict(zip(METRICS, (semantic, 0.6, 0.94, 0.5, 0.92, 0.9, annotation)))
    warns = ("mask_boundary", "artifact_free", "annotation_consistency")
    hard = [m for m in METRICS if m not in warns]
    den = " + ".join(f"CASE WHEN {m} IS NULL THEN 0::DOUBLE ELSE {d(w)} END" for m, w in weight.items())
    num = " + ".join(f"coalesce({m} * ({d(w)} / den), 0::DOUBLE)" for m, w in weight.items())
    below = {m: f"coalesce({m} < {d(t)}, false)" for m, t in least.items()}
    near = {m: f"({below[m]} AND {m} - {d(t)} >= -{d(band)} AND raw >= {d(minimum)})" if band and m in hard else "false" for m, t in least.items()}
    ors = lambda parts: "(" + " OR ".join(parts) + ")"
    earlier = lambda m: ors(["false", *(near[h] for h in hard[: hard.index(m)])])
    codes = []
    for m in METRICS:
        if m in hard:
            codes.append(f"CASE WHEN {near[m]} AND NOT {earlier(m)} THEN 'REVIEW_BORDERLINE' END")
        codes.append(f"CASE WHEN {below[m]} THEN '{reason[m]}' END")
    codes += ["CASE WHEN low THEN 'BELOW_MINIMUM_OVERALL' END", "CASE WHEN gone THEN 'EVALUATOR_FAILED' END", "CASE WHEN NOT (failed OR low OR gone OR border) AND doubtful THEN 'REVIEW_BORDERLINE' END"]
    return f"""w{suffix} AS (SELECT *, {den} AS den FROM cand), o{suffix} AS (SELECT *, least(greatest({num}, 0), 1) AS raw FROM w{suffix}),
f{suffix} AS (SELECT *, round(raw, 6) AS overall, {ors(f'({below[m]} AND NOT {near[m]})' for m in hard)} AS failed, {ors(near.values())} AS border,
  {ors(below[m] for m in warns)} AND raw < {d(minimum)} + {d(band)} AS doubtful, {ors(f'{m} IS NULL' for m in METRICS) if missing else 'false'} AS gone FROM o{suffix}),
l{suffix} AS (SELECT *, NOT failed AND raw < {d(minimum)} AS low FROM f{suffix}),
d{suffix} AS (SELECT *, CASE WHEN failed OR low OR gone THEN 'rejected' WHEN border OR doubtful THEN 'needs_review' ELSE 'accepted' END AS decision,
  [x FOR x IN [{', '.join(codes)}] IF x IS NOT NULL] AS codes FROM l{suffix})"""


BASE = f"WITH {EVIDENCE_SQL}, " + _decide_sql(0.85, 0.03, 0.95, 0.20)
STRICTLY = f"WITH {EVIDENCE_SQL}, " + _decide_sql(0.85, 0, 0.95, 0.20, missing=True)


def gate_decisions(spark, d):
    return _decided(spark, d).select("candidate_id", "category", "overall", "decision", F.concat_ws(",", "reason_codes").alias("codes"))


def gate_decisions_long(spark, d):
    wide = gates.widen(long_evidence(spark, d), ["candidate_id", "category"], POLICY)
    return gates.decide(wide, POLICY).select("candidate_id", "category", "overall", "decision")


def gate_decisions_strict(spark, d):
    return _decided(spark, d, STRICT).select("candidate_id", "decision", F.concat_ws(",", "reason_codes").alias("codes"))


def gate_overall(spark, d):
    return _decided(spark, d).groupBy("category").agg(F.round(F.avg("overall"), 6).alias("mean_overall"), F.min("overall").alias("least"), F.max("overall").alias("most"))


def gate_reason_codes(spark, d):
    return gates.reason_histogram(_decided(spark, d))


def acceptance_by_category(spark, d):
    return gates.acceptance(_decided(spark, d), ["category"])


def metric_averages(spark, d):
    return report.metric_averages(long_evidence(spark, d), ["category"])


def policy_reevaluation_changed(spark, d):
    return gates.reevaluate(evidence(spark, d), ["candidate_id", "category"], POLICY, LOOSER).groupBy("category", "old_decision", "new_decision").agg(F.count("*").alias("n"))


def reason_histogram(spark, d):
    """Over the stored reason codes (JSON arrays) of the candidates."""
    codes = table(spark, d, "candidates").select(F.explode(F.from_json("reason_codes", "array<string>")).alias("reason_code"))
    return codes.groupBy("reason_code").agg(F.count("*").alias("n"))


_MEASURED = ["candidate_id", "found", "coverage", "expected_coverage", "ssim", "changed_ratio", "perceptual_delta", "seam", "gradient_gap", "interior_area", "floating", "edge_density", "text_like", "component_ratio", "centroid_shift", "area_ratio", "aspect_delta", "contact_shift"]
_MEASURED_EXPR = [
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", "l_returnflag <> 'R'", "l_quantity / 100", "CAST(0.3 AS DOUBLE)", "1 - l_tax", "l_discount", "1 - l_discount", "l_quantity / 50", "l_tax * 5",
    "CASE WHEN l_quantity < 2 THEN NULL ELSE l_quantity - 2 END", "l_discount * 5", "l_tax * 5", "l_discount", "1 - l_tax", "l_discount", "l_quantity / 25", "l_tax * 5", "l_tax",
]
MEASURED_SQL = "mea AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in zip(_MEASURED, _MEASURED_EXPR)) + " FROM lineitem)"


def _measured(spark, d):
    return table(spark, d, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in zip(_MEASURED, _MEASURED_EXPR)])


def _outcome(operator, metric):
    def query(spark, d):
        df = operator(_measured(spark, d))
        return df.select("candidate_id", metric, F.col(f"{metric}_status").alias("status"), F.concat_ws(",", f"{metric}__codes").alias("codes"))

    query.__name__ = f"{metric}_outcome"
    return query


def _unit(x):
    return f"least(greatest({x}, 0), 1)"


def _outcome_sql(metric, value, passed, codes, bad):
    return f"""WITH {MEASURED_SQL}, v AS (SELECT *, round({value}, 6) AS {metric} FROM mea)
SELECT candidate_id, {metric}, CASE WHEN {metric} IS NULL THEN 'skipped' WHEN {passed} THEN 'passed' ELSE '{bad}' END AS status,
  CASE WHEN {metric} IS NULL OR {passed} THEN '' ELSE {codes} END AS codes FROM v"""


_HOLLOW = "CASE WHEN interior_area > 0 THEN 0.25 ELSE 0 END"
_GEO = "concat_ws(',', CASE WHEN centroid_shift > 0.08 THEN 'GEOMETRY_CENTROID_SHIFT' END, CASE WHEN area_ratio < 0.7 OR area_ratio > 1.45 THEN 'GEOMETRY_SCALE_CHANGE' END, CASE WHEN aspect_delta > 0.3 THEN 'GEOMETRY_ASPECT_CHANGE' END, CASE WHEN contact_shift > 0.05 THEN 'GEOMETRY_GROUND_CONTACT' END)"
_AREA = "CASE WHEN area_ratio < 0.7 THEN 0.7::DOUBLE / greatest(area_ratio, 1e-6) WHEN area_ratio > 1.45 THEN area_ratio / 1.45::DOUBLE ELSE 1.0::DOUBLE END"
OUTCOMES_SQL = {
    "target_presence_outcome": _outcome_sql("target_presence", f"CASE WHEN found AND coverage > 0 THEN {_unit('coverage / expected_coverage')} ELSE 0.0::DOUBLE END", "target_presence >= 0.6", "'OBJECT_NOT_FOUND'", "failed"),
    "background_preservation_outcome": _outcome_sql("background_preservation", _unit("0.5::DOUBLE * ssim + 0.3::DOUBLE * (1 - changed_ratio) + 0.2::DOUBLE * perceptual_delta"), "changed_ratio <= 0.06 AND background_preservation >= 0.93", "CASE WHEN changed_ratio > 0.06 THEN 'BACKGROUND_CHANGED' ELSE 'BACKGROUND_NOISE' END", "failed"),
    "mask_boundary_outcome": _outcome_sql("mask_boundary", f"CASE WHEN interior_area IS NULL THEN 0.0::DOUBLE ELSE {_unit(f'0.5::DOUBLE * seam + 0.3::DOUBLE * (1 - gradient_gap) + 0.2::DOUBLE * {_HOLLOW}')} END", "mask_boundary >= 0.6", "'MASK_BOUNDARY_ARTIFACT'", "warned"),
    "artifact_free_outcome": _outcome_sql("artifact_free", f"1 - {_unit('0.35::DOUBLE * floating + 0.25::DOUBLE * edge_density + 0.2::DOUBLE * text_like + 0.2::DOUBLE * greatest(0, 1 - component_ratio)')}", "artifact_free >= 0.9", "'ARTIFACT_DETECTED'", "warned"),
    "geometry_outcome": _outcome_sql("geometry", _unit(f"1 - greatest(0, greatest(centroid_shift / 0.08::DOUBLE, {_AREA}, aspect_delta / 0.3::DOUBLE, contact_shift / 0.05::DOUBLE) - 1)"), f"{_GEO} = ''", f"CASE WHEN contains({_GEO}, ',') THEN 'GEOMETRY_VIOLATION,' ELSE '' END || {_GEO}", "failed"),
}


def similarity_score(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(outcomes.similarity(1 - F.col("l_discount"), 0.25)), 6).alias("mean_similarity"))


_FUNCTIONS = [gate_decisions, gate_decisions_long, gate_decisions_strict, gate_overall, gate_reason_codes, acceptance_by_category, metric_averages, policy_reevaluation_changed, reason_histogram, similarity_score]
_FUNCTIONS += [_outcome(f, m) for f, m in ((outcomes.presence, "target_presence"), (outcomes.background, "background_preservation"), (outcomes.boundary, "mask_boundary"), (outcomes.artifact, "artifact_free"), (outcomes.geometry, "geometry"))]
QUERIES = {f.__name__: f for f in _FUNCTIONS}
SQL = {
    "gate_decisions": f"{BASE} SELECT candidate_id, category, overall, decision, array_to_string(codes, ',') AS codes FROM d",
    "gate_decisions_long": f"{BASE} SELECT candidate_id, category, overall, decision FROM d",
    "gate_decisions_strict": f"{STRICTLY} SELECT candidate_id, decision, array_to_string(codes, ',') AS codes FROM d",
    "gate_overall": f"{BASE} SELECT category, round(avg(overall), 6) AS mean_overall, min(overall) AS least, max(overall) AS most FROM d GROUP BY category",
    "gate_reason_codes": f"{BASE} SELECT code AS reason_code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM d) GROUP BY code",
    "acceptance_by_category": f"""{BASE} SELECT category, count(*) AS n, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'rejected') AS rejected,
  count(*) FILTER (decision = 'needs_review') AS review, round(count(*) FILTER (decision = 'accepted') / count(*), 4) AS rate FROM d GROUP BY category""",
    "metric_averages": f"WITH {EVIDENCE_SQL}, long AS (" + " UNION ALL ".join(f"SELECT category, '{m}' AS metric, {m}::DOUBLE AS value FROM cand" for m in METRICS) + ") SELECT category, metric, round(avg(value), 6) AS mean, count(value) AS n FROM long GROUP BY ALL",
    "policy_reevaluation_changed": f"{BASE}, {_decide_sql(0.80, 0.03, 0.92, 0.10, '2')} SELECT category, d.decision AS old_decision, d2.decision AS new_decision, count(*) AS n FROM d JOIN d2 USING (candidate_id, category) GROUP BY ALL",
    "reason_histogram": "SELECT code AS reason_code, count(*) AS n FROM (SELECT unnest(CAST(reason_codes AS VARCHAR[])) AS code FROM (SELECT from_json(reason_codes, '[\"VARCHAR\"]') AS reason_codes FROM candidates)) GROUP BY code",
    "similarity_score": f"SELECT l_returnflag, round(avg({_unit('1 - greatest(0, l_discount) / 0.25::DOUBLE')}), 6) AS mean_similarity FROM lineitem GROUP BY 1",
    **OUTCOMES_SQL,
}
