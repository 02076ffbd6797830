"""Run tables, progress, plans and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.functions import identity
from samplewright.operators import report, state
from samplewright.plans import stages
from samplewright.session import table


def _current(spark, d, *columns):
    """Latest attempts with the named columns only; the scan then reads no others."""
    return state.latest_attempts(table(spark, d, "node_runs").select("job_id", "node_id", "attempt", *columns))


def current_node_runs(spark, d):
    return _current(spark, d, "status", "duration_ms").select("job_id", "node_id", "attempt", "status", "duration_ms")


def job_counters(spark, d):
    return report.job_counters(_current(spark, d, "status", "cache_hit", "duration_ms"))


def stage_status_counts(spark, d):
    return report.stage_status(table(spark, d, "node_runs"))


def candidate_state_counts(spark, d):
    return table(spark, d, "candidates").groupBy("state").agg(F.count("*").alias("n"))


def resume_pending(spark, d):
    runs = _current(spark, d, "status")
    planned = table(spark, d, "node_runs").select("job_id", "node_id").distinct()
    return state.pending(planned, runs, ["job_id", "node_id"]).groupBy("job_id").agg(F.count("*").alias("pending"))


def cache_statistics(spark, d):
    entries = table(spark, d, "node_runs").groupBy("operator", "lineage").agg(F.sum("cache_hit").alias("hits"))
    return state.cache_stats(entries)


def cache_keys(spark, d):
    runs = table(spark, d, "node_runs").filter("operator is not null and operator_version is not null and lineage is not null and seed is not null")
    key = identity.cache_key(operator=F.col("operator"), version=F.col("operator_version"), inputs=F.col("lineage"), backend=F.coalesce("backend_id", F.lit("")), seed=F.col("seed"))
    return runs.select("operator", key.alias("cache_key")).distinct()


def table_counts(spark, d):
    return state.table_counts({n: table(spark, d, n) for n in ("jobs", "samples", "candidates", "provenance", "node_runs")})


def event_log_counts(spark, d):
    return state.event_counts(table(spark, d, "events"))


def candidate_transitions(spark, d):
    versions = table(spark, d, "candidates").select("candidate_id", "state", F.col("updated_at").alias("seq")).distinct()
    return report.transitions(versions).groupBy("from_state", "state").agg(F.count("*").alias("n"))


def state_upsert(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = rows.filter("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X"))
    return state.upsert(rows, changed, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def newest_jobs(spark, d):
    return table(spark, d, "jobs").orderBy(F.col("created_at").desc(), "job_id").limit(10).select("job_id", "state")


def plan_estimate(spark, d):
    planned = table(spark, d, "node_runs").select("job_id", "node_id", "stage", "backend_id").distinct()
    profile = spark.createDataFrame([(k, *v) for k, v in stages.UNIT_ESTIMATES.items()], "backend_id string, seconds double, cost double")
    return report.plan_estimate(planned, profile).withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def plan_nodes_per_sample(spark, d):
    """Nodes a plan reserves for each sample of a job, and how many ran."""
    plan = stages.StagePlan(max_per_sample=2, candidates_per_object=3)
    runs = table(spark, d, "node_runs").filter("lineage is not null").select("job_id", F.regexp_extract("lineage", "sample:([^/]+)", 1).alias("sample"), "node_id").distinct()
    return runs.groupBy("job_id").agg(F.countDistinct("sample").alias("samples"), F.count("*").alias("ran")).withColumn("reserved", F.col("samples") * plan.nodes_per_sample)


def sample_outcome_counters(spark, d):
    """Candidates of each sample by state, and the share accepted."""
    count = lambda v: F.count_if(F.col("state") == v)
    current = table(spark, d, "candidates").groupBy("candidate_id").agg(F.max_by(F.struct("sample_id", "state"), "updated_at").alias("c")).select("c.*")
    return current.groupBy("sample_id").agg(F.count("*").alias("n"), *[count(v).alias(v) for v in ("accepted", "review", "rejected", "generated")], F.round(count("accepted") / F.count("*"), 4).alias("rate"))


def top_reasons(spark, d):
    """The five most frequent reason codes, ties by name."""
    codes = table(spark, d, "candidates").select(F.explode(F.from_json("reason_codes", "array<string>")).alias("reason_code"))
    return codes.groupBy("reason_code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "reason_code").limit(5)


def operator_durations(spark, d):
    """Known durations of each operator: runs, their sum (null if none is known), the longest."""
    return table(spark, d, "node_runs").groupBy("operator").agg(F.count("duration_ms").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"))


FUNCTIONS = [sample_outcome_counters, top_reasons, operator_durations, current_node_runs, job_counters, stage_status_counts, candidate_state_counts, resume_pending, cache_statistics, cache_keys, table_counts, event_log_counts, candidate_transitions, state_upsert, newest_jobs, plan_estimate, plan_nodes_per_sample]
QUERIES = {f.__name__: f for f in FUNCTIONS}
_LATEST = "cur AS (SELECT * FROM (SELECT DISTINCT * FROM node_runs) QUALIFY row_number() OVER (PARTITION BY job_id, node_id ORDER BY attempt DESC) = 1)"
_UNITS = ", ".join(f"('{k}', {s}::DOUBLE, {c}::DOUBLE)" for k, (s, c) in stages.UNIT_ESTIMATES.items())
SQL = {
    "sample_outcome_counters": """WITH cur AS (SELECT sample_id, state FROM candidates WHERE candidate_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY updated_at DESC) = 1)
SELECT sample_id, count(*) AS n, count(*) FILTER (state = 'accepted') AS accepted, count(*) FILTER (state = 'review') AS review, count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'generated') AS generated,
  round(count(*) FILTER (state = 'accepted') / count(*), 4) AS rate FROM cur GROUP BY sample_id""",
    "top_reasons": "SELECT code AS reason_code, count(*) AS n FROM (SELECT unnest(from_json(reason_codes, '[\"VARCHAR\"]')) AS code FROM candidates) GROUP BY code ORDER BY n DESC, code LIMIT 5",
    "operator_durations": "SELECT operator, count(duration_ms) AS n, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS longest_ms FROM node_runs GROUP BY operator",
    "current_node_runs": f"WITH {_LATEST} SELECT job_id, node_id, attempt, status, duration_ms FROM cur",
    "job_counters": f"""WITH {_LATEST} SELECT job_id, count(*) AS nodes, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (cache_hit = 1) AS cache_hits, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM cur GROUP BY job_id""",
    "stage_status_counts": "SELECT stage, status, count(*) AS n FROM node_runs GROUP BY ALL",
    "candidate_state_counts": "SELECT state, count(*) AS n FROM candidates GROUP BY ALL",
    "resume_pending": f"WITH {_LATEST} SELECT job_id, count(*) AS pending FROM cur WHERE status NOT IN ('succeeded', 'skipped') OR status IS NULL GROUP BY job_id",
    "cache_statistics": "SELECT count(*) AS entries, CAST(coalesce(sum(h), 0) AS BIGINT) AS hits FROM (SELECT operator, lineage, sum(cache_hit) AS h FROM node_runs GROUP BY ALL)",
    "cache_keys": """SELECT DISTINCT operator, sha256('{"backend":"' || coalesce(backend_id, '') || '","inputs":"' || lineage || '","operator":"' || operator || '","seed":"' || seed || '","version":"' || operator_version || '"}') AS cache_key
  FROM node_runs WHERE operator IS NOT NULL AND operator_version IS NOT NULL AND lineage IS NOT NULL AND seed IS NOT NULL""",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("jobs", "samples", "candidates", "provenance", "node_runs")),
    "event_log_counts": "SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS with_key, count(*) FILTER (props IS NOT NULL AND json_extract(props, '$.k') IS NULL) AS broken FROM events GROUP BY 1",
    "candidate_transitions": "SELECT from_state, state, count(*) AS n FROM (SELECT candidate_id, state, lag(state) OVER (PARTITION BY candidate_id ORDER BY updated_at) AS from_state FROM (SELECT DISTINCT candidate_id, state, updated_at FROM candidates)) WHERE from_state IS NULL OR from_state <> state GROUP BY ALL",
    "state_upsert": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "newest_jobs": "SELECT job_id, state FROM jobs ORDER BY created_at DESC, job_id LIMIT 10",
    "plan_estimate": f"""WITH p AS (SELECT DISTINCT job_id, node_id, stage, backend_id FROM node_runs), u(backend_id, seconds, cost) AS (VALUES {_UNITS})
SELECT stage, count(*) AS nodes, round(sum(coalesce(seconds, 0)), 6) AS seconds, coalesce(round(sum(cost), 6), 0) AS cost FROM p LEFT JOIN u USING (backend_id) GROUP BY stage""",
    "plan_nodes_per_sample": "SELECT job_id, count(DISTINCT sample) AS samples, count(*) AS ran, count(DISTINCT sample) * (3 + 2 * (3 + 6 * 3)) AS reserved FROM (SELECT DISTINCT job_id, regexp_extract(lineage, 'sample:([^/]+)', 1) AS sample, node_id FROM node_runs WHERE lineage IS NOT NULL) GROUP BY job_id",
}
