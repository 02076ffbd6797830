"""The acceptance gate: a declarative policy over measured metrics.

A policy has few gates, so it is compiled into column expressions. Wide evidence (one column a metric)
is decided without any shuffle, long evidence with one map-side combined aggregation. Applying
another policy to stored evidence is the same call with another policy.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric names with their default weights and the reason a failed metric gives.
METRICS = {
    "semantic_match": (0.24, "SEMANTIC_MISMATCH"),
    "target_presence": (0.16, "OBJECT_NOT_FOUND"),
    "background_preservation": (0.22, "BACKGROUND_CHANGED"),
    "mask_boundary": (0.10, "MASK_BOUNDARY_ARTIFACT"),
    "geometry": (0.12, "GEOMETRY_VIOLATION"),
    "artifact_free": (0.10, "ARTIFACT_DETECTED"),
    "annotation_consistency": (0.06, "ANNOTATION_MISMATCH"),
}


@dataclass(frozen=True)
class Gate:
    metric: str
    threshold: float
    severity: str = "hard"
    comparison: str = "at_least"

    def margin(self, value: Column) -> Column:
        """Signed distance to the threshold, negative where the gate fails."""
        return value - F.lit(self.threshold) if self.comparison == "at_least" else F.lit(self.threshold) - value

    def passes(self, value: Column) -> Column:
        """Compared as measured, without rounding."""
        return value >= self.threshold if self.comparison == "at_least" else value <= self.threshold


@dataclass(frozen=True)
class Policy:
    minimum_overall: float = 0.90
    review_band: float = 0.03
    allow_missing: bool = True
    gates: Sequence[Gate] = ()
    weights: dict[str, float] = field(default_factory=dict)

    @property
    def metrics(self) -> list[str]:
        """Every metric the policy weighs or gates, in the fixed order first."""
        named = [*METRICS, *self.weights, *(g.metric for g in self.gates)]
        return list(dict.fromkeys(named))

    @property
    def digest(self) -> str:
        """SHA-256 of the policy's canonical JSON; it is recorded with every decision, so that evidence can be told from evidence under another policy."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def weight(self, metric: str) -> float:
        return max(0.0, self.weights.get(metric, METRICS.get(metric, (0.0, ""))[0]))


def overall(policy: Policy, metrics: Sequence[str]) -> Column:
    """Weighted mean over the measured metrics, unrounded; equal weights if theirs sum to nothing, 0 if nothing was measured."""
    here = {m: F.col(m).isNotNull() for m in metrics}
    total = sum((F.when(here[m], policy.weight(m)).otherwise(0.0) for m in metrics), F.lit(0.0))
    weighted = sum((F.coalesce(F.col(m) * F.try_divide(F.lit(policy.weight(m)), total), F.lit(0.0)) for m in metrics), F.lit(0.0))
    if all(policy.weight(m) > 0 for m in metrics):
        return F.least(F.greatest(weighted, F.lit(0.0)), F.lit(1.0))
    count = sum((F.when(here[m], 1).otherwise(0) for m in metrics), F.lit(0))
    plain = sum((F.coalesce(F.try_divide(F.col(m), count), F.lit(0.0)) for m in metrics), F.lit(0.0))
    return F.least(F.greatest(F.when(total > 0, weighted).otherwise(plain), F.lit(0.0)), F.lit(1.0))


def widen(long: DataFrame, keys: Sequence[str], policy: Policy, codes: str | None = None) -> DataFrame:
    """One row per candidate from rows ``keys, metric, value[, codes]``; partial aggregation before the only shuffle."""
    columns = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in policy.metrics]
    if codes:
        columns += [F.max(F.when(F.col("metric") == m, F.col(codes))).alias(f"{m}__codes") for m in policy.metrics]
    return long.groupBy(*keys).agg(*columns)


_PASSED, _MISSING, _BORDERLINE, _FAILED, _WARNED = range(5)


def decide(wide: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``overall, failed_gates, borderline_gates, warned_gates, missing_gates, reason_codes, decision, policy_hash``.

    A metric column may be absent from ``wide``; codes in ``<metric>__codes`` win over the default ones. Scores are compared as measured; ``overall`` is
    rounded to six places where it is given out. The state of each gate is a small integer column, and the lists are put together from these only where they are asked for.
    """
    have = [m for m in policy.metrics if m in wide.columns]
    scored = wide.withColumn("__overall", overall(policy, have))
    enough = F.col("__overall") >= policy.minimum_overall
    states = {}
    for i, gate in enumerate(policy.gates):
        value = F.col(gate.metric) if gate.metric in have else F.lit(None).cast("double")
        near = (gate.margin(value) >= -policy.review_band) & enough if policy.review_band > 0 else F.lit(False)
        failing = F.when(near, _BORDERLINE).otherwise(_FAILED) if gate.severity == "hard" else F.lit(_WARNED)
        states[f"__g{i}"] = F.when(value.isNull(), _MISSING).when(gate.passes(value), _PASSED).otherwise(failing)
    judged = scored.withColumns(states) if states else scored
    none = F.array().cast("array<string>")
    some = lambda on, code: F.when(on, F.array(F.lit(code))).otherwise(none)
    joined = lambda parts: F.flatten(F.array(*parts)) if parts else none
    gates = [(F.col(f"__g{i}"), g) for i, g in enumerate(policy.gates)]
    any_in = lambda state: reduce(Column.__or__, [at == state for at, _ in gates], F.lit(False))
    in_state = lambda state, mark="": [some(at == state, g.metric + mark) for at, g in gates]
    low = ~any_in(_FAILED) & ~enough
    gone = F.lit(False) if policy.allow_missing else any_in(_MISSING)
    rejected, review = any_in(_FAILED) | low | gone, any_in(_BORDERLINE)
    doubtful = any_in(_WARNED) & (F.col("__overall") < policy.minimum_overall + policy.review_band)
    failed = joined([*in_state(_FAILED), some(low, "overall"), *([] if policy.allow_missing else in_state(_MISSING, ":missing"))])
    codes = []
    for at, gate in gates:
        default = F.array(F.lit(METRICS[gate.metric][1])) if gate.metric in METRICS else none
        own = f"{gate.metric}__codes"
        named = F.when(F.size(own) > 0, F.col(own)).otherwise(default) if own in wide.columns else default
        codes.append(F.when(at.isin(_FAILED, _WARNED), named).when(at == _BORDERLINE, F.concat(F.array(F.lit("REVIEW_BORDERLINE")), named)).otherwise(none))
    codes += [some(low, "BELOW_MINIMUM_OVERALL"), some(gone, "EVALUATOR_FAILED"), some(~rejected & ~review & doubtful, "REVIEW_BORDERLINE")]
    state = F.when(rejected, "rejected").when(review | doubtful, "needs_review").otherwise("accepted")
    return judged.select(
        *wide.columns, F.round("__overall", 6).alias("overall"), failed.alias("failed_gates"), joined(in_state(_BORDERLINE)).alias("borderline_gates"), joined(in_state(_WARNED)).alias("warned_gates"),
        joined(in_state(_MISSING)).alias("missing_gates"), F.array_distinct(joined(codes)).alias("reason_codes"), state.alias("decision"), F.lit(policy.digest).alias("policy_hash"),
    )


def reevaluate(wide: DataFrame, keys: Sequence[str], old: Policy, new: Policy) -> DataFrame:
    """``keys, old_decision, new_decision, changed`` after exchanging the policy; one pass over the evidence."""
    before = decide(wide, old).select(*wide.columns, F.col("decision").alias("old_decision"))
    after = decide(before, new)
    return after.select(*keys, "old_decision", F.col("decision").alias("new_decision"), (F.col("old_decision") != F.col("decision")).alias("changed"))


def acceptance(decided: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per state and the acceptance rate."""
    count = lambda s: F.count_if(F.col("decision") == s)
    return decided.groupBy(*by).agg(
        F.count("*").alias("n"), count("accepted").alias("accepted"), count("rejected").alias("rejected"), count("needs_review").alias("review"),
        F.round(count("accepted") / F.greatest(F.count("*"), F.lit(1)), 4).alias("rate"),
    )


def reason_histogram(decided: DataFrame) -> DataFrame:
    """How often each reason code was given."""
    return decided.select(F.explode("reason_codes").alias("reason_code")).groupBy("reason_code").agg(F.count("*").alias("n"))
