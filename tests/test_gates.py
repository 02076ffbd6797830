import hypothesis.strategies as st
from hypothesis import HealthCheck, given, settings

from samplewright.operators import gates

G = gates.Gate
POLICY = gates.Policy(0.9, 0.03, True, (G("semantic_match", 0.95), G("background_preservation", 0.9), G("mask_boundary", 0.6, "warn")))


def decide(spark, rows, policy=POLICY):
    df = spark.createDataFrame(rows, "id string, semantic_match double, background_preservation double, mask_boundary double")
    return {r["id"]: r for r in gates.decide(df, policy).collect()}


def test_states_and_codes(spark):
    out = decide(spark, [("ok", 0.99, 0.99, 0.9), ("hard", 0.5, 0.99, 0.9), ("near", 0.93, 0.99, 0.9), ("warn", 0.96, 0.9, 0.5), ("null", None, 0.99, None), ("none", None, None, None)])
    assert out["ok"]["decision"] == "accepted" and out["ok"]["reason_codes"] == []
    assert out["hard"]["decision"] == "rejected" and out["hard"]["failed_gates"] == ["semantic_match"]
    assert out["near"]["decision"] == "needs_review" and out["near"]["reason_codes"] == ["REVIEW_BORDERLINE", "SEMANTIC_MISMATCH"]
    assert out["warn"]["warned_gates"] == ["mask_boundary"] and "MASK_BOUNDARY_ARTIFACT" in out["warn"]["reason_codes"]
    assert out["null"]["missing_gates"] == ["semantic_match", "mask_boundary"] and out["null"]["decision"] == "accepted"
    assert out["none"]["overall"] == 0 and out["none"]["reason_codes"] == ["BELOW_MINIMUM_OVERALL"]


def test_missing_metrics_may_be_refused(spark):
    strict = gates.Policy(0.9, 0.03, False, POLICY.gates)
    out = decide(spark, [("a", None, 0.99, 0.9)], strict)["a"]
    assert out["decision"] == "rejected" and out["failed_gates"] == ["semantic_match:missing"] and "EVALUATOR_FAILED" in out["reason_codes"]


def test_codes_of_a_measurement_win(spark):
    df = spark.createDataFrame([("a", 0.1, ["WRONG_CLASS"]), ("b", 0.1, [])], "id string, semantic_match double, semantic_match__codes array<string>")
    out = {r["id"]: r["reason_codes"] for r in gates.decide(df, gates.Policy(0.0, 0.0, True, (G("semantic_match", 0.95),))).collect()}
    assert out == {"a": ["WRONG_CLASS"], "b": ["SEMANTIC_MISMATCH"]}


def test_weights_of_zero_fall_back_to_equal_ones(spark):
    policy = gates.Policy(0.0, 0.0, True, (), {m: 0.0 for m in gates.METRICS})
    assert decide(spark, [("a", 0.2, 0.4, 0.9)], policy)["a"]["overall"] == 0.5


def test_long_and_wide_evidence_agree(spark):
    long = spark.createDataFrame([("a", "semantic_match", 0.99), ("a", "background_preservation", 0.99), ("a", "mask_boundary", None)], "id string, metric string, value double")
    wide = gates.widen(long, ["id"], POLICY)
    assert gates.decide(wide, POLICY).first()["decision"] == "accepted"


def test_scores_are_judged_as_measured(spark):
    """0.8999996 is below 0.90, and a margin of -0.03 and a little is outside of a band of 0.03."""
    one = gates.Policy(0.90, 0.03, True, (G("semantic_match", 0.95),), {m: float(m == "semantic_match") for m in gates.METRICS})
    df = spark.createDataFrame([("low", 0.8999996), ("out", 0.9199999999), ("in", 0.9200000001)], "id string, semantic_match double")
    out = {r["id"]: r for r in gates.decide(df, one).collect()}
    assert out["low"]["overall"] == 0.9 and out["low"]["decision"] == "rejected" and out["out"]["decision"] == "rejected" and out["in"]["decision"] == "needs_review"
    assert out["in"]["reason_codes"] == ["REVIEW_BORDERLINE", "SEMANTIC_MISMATCH"]


def test_the_policy_is_recorded(spark):
    same, other = gates.Policy(0.9, 0.03, True, POLICY.gates), gates.Policy(0.9, 0.03, True, (*POLICY.gates[:2], G("mask_boundary", 0.61, "warn")))
    assert same.digest == POLICY.digest != other.digest
    assert decide(spark, [("a", 1.0, 1.0, 1.0)])["a"]["policy_hash"] == POLICY.digest


def test_empty_input(spark):
    assert decide(spark, []) == {}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=3, max_size=3), st.floats(0, 1), st.floats(0, 1))
def test_a_higher_threshold_never_accepts_more(spark, values, a, b):
    low, high = sorted((a, b))
    rank = {"rejected": 0, "needs_review": 1, "accepted": 2}
    state = [rank[decide(spark, [("x", *values)], gates.Policy(0.5, 0.03, True, (G("semantic_match", t),)))["x"]["decision"]] for t in (low, high)]
    assert state[1] <= state[0]
