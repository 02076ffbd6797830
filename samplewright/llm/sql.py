"""SQL for DuckDB with the results of the pN queries that SQL can express."""

BARE = r"lower(regexp_replace({0}, '^[\s\pZ\pC]+|[\s\pZ\pC]+$', '', 'g'))"


def bare(x):
    return BARE.format(x)


def digest(x):
    plain = f"regexp_replace({bare(x)}, '^sha256:[\\s\\pZ\\pC]*', '')"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9a-f]{{16,64}}') THEN {plain} END"


def fingerprint(x):
    plain = f"regexp_replace({bare(x)}, '^0x', '')"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9a-f]{{1,16}}') THEN ('0x' || lpad({plain}, 16, '0'))::UBIGINT END"


SPLIT = f"CASE WHEN {bare('split')} IN ('train', 'training') THEN 'train' WHEN {bare('split')} IN ('val', 'valid', 'validation') THEN 'validation' WHEN {bare('split')} IN ('test', 'testing') THEN 'test' END"
SCORE = "CASE WHEN overall_score BETWEEN 0 AND 1 AND NOT isnan(overall_score) THEN overall_score + 0.0 END"
CATEGORY = r"regexp_replace({0}, '[\s\pZ_]', '-', 'g')".format(bare("category"))

CURRENT = f"""cur AS (SELECT candidate_id, sample_id, target_object_id, {CATEGORY} AS cat, {SCORE} AS s, {digest('output_digest')} AS output
  FROM candidates WHERE candidate_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY updated_at DESC) = 1)"""

CUTS = f"""WITH {CURRENT},
scored AS (SELECT candidate_id, cat, s FROM cur WHERE s IS NOT NULL AND cat IS NOT NULL),
goal AS (SELECT {CATEGORY} AS cat, max(least(keep_permille, 1000)) AS permille FROM keep_targets WHERE keep_permille > 0 GROUP BY 1),
ranked AS (SELECT scored.*, row_number() OVER (PARTITION BY cat ORDER BY s DESC) AS r, count(*) OVER (PARTITION BY cat) AS n FROM scored),
cut AS (SELECT cat, n, (n * permille + 999) // 1000 AS k, s AS cutoff FROM ranked JOIN goal USING (cat) WHERE r = (n * permille + 999) // 1000)"""

PAIRS = f"""WITH {CURRENT},
rec AS (SELECT DISTINCT p.candidate_id AS id, {SPLIT} AS split, {digest('source_digest')} AS source, output, {fingerprint('perceptual_hash')} AS h
  FROM provenance p LEFT JOIN cur USING (candidate_id)),
met AS (SELECT t.id AS t, e.id AS e, e.split AS split, e.source AS source_digest,
    coalesce(starts_with(t.source, e.source) OR starts_with(e.source, t.source), false) AS by_source,
    coalesce(starts_with(t.output, e.output) OR starts_with(e.output, t.output), false) AS by_output,
    coalesce(bit_count(xor(t.h, e.h)) <= 6, false) AS by_hash
  FROM rec t JOIN rec e ON t.split = 'train' AND e.split <> 'train'),
hit AS (SELECT * FROM met WHERE by_source OR by_output OR by_hash)"""

RUNS = f"""WITH cur AS (SELECT * FROM node_runs WHERE job_id IS NOT NULL AND node_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY job_id, node_id ORDER BY attempt DESC) = 1),
runs AS (SELECT operator, backend_id, CAST(CAST(started_at AS DATE) AS VARCHAR) AS run_day, duration_ms FROM cur
  WHERE {bare('status')} = 'succeeded' AND cache_hit = 0 AND duration_ms >= 0 AND backend_id IS NOT NULL AND started_at IS NOT NULL)"""

# Candidates in order, with the earlier ones that each is linked to, then one after the other: a list of those that were struck.
HISTORY = f"""WITH RECURSIVE old AS MATERIALIZED (SELECT sample_id AS id, {digest('digest')} AS d, {fingerprint('perceptual_hash')} AS h FROM samples WHERE {bare('state')} IN ('source', 'accepted')),
now AS (SELECT * FROM candidates WHERE candidate_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY updated_at DESC) = 1),
ph AS (SELECT candidate_id, {fingerprint('perceptual_hash')} AS h FROM provenance WHERE candidate_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC) = 1),
whenj AS (SELECT job_id, min(created_at) AS job_at FROM jobs GROUP BY job_id),
new AS MATERIALIZED (SELECT candidate_id AS id, {digest('output_digest')} AS d, h, row_number() OVER (ORDER BY coalesce(job_at, TIMESTAMP '9999-12-31'), candidate_id) AS k
  FROM now LEFT JOIN ph USING (candidate_id) LEFT JOIN whenj USING (job_id) WHERE {bare('state')} = 'accepted'),
same AS (SELECT b.k, a.id AS ref, 0 AS pool, 0::BIGINT AS since, 0 AS distance FROM new b JOIN old a ON left(a.d, 16) = left(b.d, 16) AND (starts_with(a.d, b.d) OR starts_with(b.d, a.d))
  UNION ALL SELECT b.k, a.id, 1, a.k, 0 FROM new b JOIN new a ON a.k < b.k AND left(a.d, 16) = left(b.d, 16) AND (starts_with(a.d, b.d) OR starts_with(b.d, a.d))),
near AS (SELECT b.k, a.id AS ref, 0 AS pool, 0::BIGINT AS since, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM new b JOIN old a ON bit_count(xor(a.h, b.h)) <= 6
  UNION ALL SELECT b.k, a.id, 1, a.k, bit_count(xor(a.h, b.h))::INTEGER FROM new b JOIN new a ON a.k < b.k AND bit_count(xor(a.h, b.h)) <= 6),
link AS MATERIALIZED (SELECT * FROM same UNION ALL SELECT * FROM near),
open AS MATERIALIZED (SELECT k, row_number() OVER (ORDER BY k) AS i, bool_or(pool = 0) AS hit, list(since) FILTER (pool = 1) AS before FROM link GROUP BY k),
step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS struck UNION ALL SELECT o.i, CASE WHEN hit OR coalesce(len([1 FOR x IN before IF NOT list_contains(struck, x)]), 0) > 0 THEN list_append(struck, o.k) ELSE struck END FROM step JOIN open o ON o.i = step.i + 1),
gone AS (SELECT unnest(struck) AS k FROM step WHERE i = (SELECT max(i) FROM step))"""

SQL = {
    "p1_found": f"{HISTORY} SELECT id AS candidate_id FROM new JOIN gone USING (k)",
    "p1_decisions": f"""{HISTORY}, best AS (SELECT k, arg_min(struct_pack(ref, distance), struct_pack(distance, pool, since, ref)) AS m FROM link JOIN gone USING (k)
  WHERE pool = 0 OR since NOT IN (SELECT k FROM gone) GROUP BY k)
SELECT id AS candidate_id, CASE WHEN m.distance = 0 THEN 'exact' ELSE 'near' END AS kind, m.ref AS reference_id, m.distance AS distance FROM best JOIN new USING (k)""",
    "p2_found": f"{CUTS} SELECT scored.cat AS category, candidate_id FROM scored JOIN cut USING (cat) WHERE s >= cutoff",
    "p2_cutoffs": f"{CUTS} SELECT cat AS category, cut.n, k, cutoff, count(*) AS kept FROM scored JOIN cut USING (cat) WHERE s >= cutoff GROUP BY ALL",
    "p3_found": f"{PAIRS} SELECT least(t, e) AS candidate_a, greatest(t, e) AS candidate_b FROM hit",
    "p3_report": f"""{PAIRS} SELECT split, source_digest, count(*) AS n_pairs, count(DISTINCT e) AS n_records,
  count(*) FILTER (by_source) AS by_source, count(*) FILTER (by_output AND NOT by_source) AS by_output,
  count(*) FILTER (by_hash AND NOT by_source AND NOT by_output) AS by_hash FROM hit GROUP BY ALL""",
    "p4_found": f"""WITH {CURRENT} SELECT sample_id, target_object_id, candidate_id FROM cur WHERE s IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sample_id, target_object_id ORDER BY s DESC, candidate_id) <= 3""",
    "p5_found": f"""{RUNS}, whole AS (SELECT operator, backend_id, quantile_disc(duration_ms, 0.5) AS m FROM runs GROUP BY ALL)
  SELECT operator, backend_id, run_day FROM runs JOIN whole USING (operator, backend_id) GROUP BY operator, backend_id, run_day, m
  HAVING count(*) >= 12 AND quantile_disc(duration_ms, 0.5) > 2 * m""",
}
