"""Targets, boxes, splits, lineage, identities and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplewright.catalogue.bridge import DETECTIONS_SQL, detections, rasters
from samplewright.functions import clean, identity
from samplewright.functions import geometry as g
from samplewright.operators import dedup, lineage, report, select
from samplewright.session import table

WITH = f"WITH {DETECTIONS_SQL}"
CLASSES, SCORE, AREA, CAP = ("A", "R"), 0.70, 2000.0, 2


def select_targets_topk(spark, d):
    return select.select_targets(detections(spark, d), CLASSES, SCORE, AREA, CAP).select("sample_id", "object_id", "ordinal")


def select_targets_largest(spark, d):
    return select.select_targets(detections(spark, d), CLASSES, SCORE, AREA, CAP, strategy="largest").select("sample_id", "object_id", "area")


def selection_drop_counters(spark, d):
    return select.drop_counters(detections(spark, d), CLASSES, SCORE, AREA, CAP)


def _targets(spark, d):
    return detections(spark, d).filter("class_name = 'A' and score >= 0.9")


def best_match_iou(spark, d):
    return select.best_match(_targets(spark, d), detections(spark, d).filter("class_name <> 'A'"), 0.05)


def nearest_neighbours(spark, d):
    return select.neighbours(_targets(spark, d), detections(spark, d))


def occlusion_relations(spark, d):
    return select.occlusions(_targets(spark, d), detections(spark, d))


def bbox_geometry(spark, d):
    b = g.box()
    cx, cy = g.centroid(b)
    return detections(spark, d).select("object_id", g.width(b).alias("width"), g.height(b).alias("height"), g.area(b).alias("box_area"), F.round(g.aspect(b), 6).alias("aspect"), cx.alias("cx"), cy.alias("cy"), g.contains(b, F.lit(300.0), F.lit(200.0)).alias("holds_point"))


def box_clip_normalise(spark, d):
    b = g.clip(g.expand(g.box(), 10.0), F.col("image_width"), F.col("image_height"))
    n = g.normalise(b, F.col("image_width"), F.col("image_height"))
    return detections(spark, d).select("object_id", *[F.round(v, 6).alias(e) for e, v in n.items()])


def polygon_area(spark, d):
    b = g.box()
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cx, _ = g.centroid(b)
    ring = F.array(point(b["x_min"], b["y_max"]), point(cx, b["y_min"]), point(b["x_max"], b["y_max"]), point(cx, b["y_max"] - g.height(b) / 4))
    return detections(spark, d).select("object_id", F.round(g.polygon_area(ring), 6).alias("polygon_area"))


def size_buckets(spark, d):
    return report.bucketed(detections(spark, d)).groupBy("size_bucket").agg(F.count("*").alias("n"))


def aspect_buckets(spark, d):
    return report.bucketed(detections(spark, d)).groupBy("aspect_bucket").agg(F.count("*").alias("n"))


def scale_class(spark, d):
    return report.bucketed(detections(spark, d)).groupBy("scale_class").agg(F.count("*").alias("n"))


def distribution_histograms(spark, d):
    return report.histograms(report.bucketed(detections(spark, d)), ["class_name", "size_bucket", "aspect_bucket", "scale_class"])


def dataset_inspect(spark, d):
    b = g.box()
    return detections(spark, d).groupBy("class_name").agg(F.count("*").alias("objects"), F.countDistinct("sample_id").alias("samples"), F.max(g.width(b)).alias("widest"), F.max(g.height(b)).alias("highest"))


def split_assign_directory(spark, d):
    return table(spark, d, "samples").select("sample_id", lineage.split_from_directory(F.col("rel_path")).alias("split"))


def split_assign_filename(spark, d):
    name = F.concat(F.col("split"), F.lit("_"), F.col("sample_id"), F.lit(".png"))
    return table(spark, d, "samples").filter("split is not null").select("sample_id", lineage.split_from_filename(name).alias("split"))


def split_assign_manifest(spark, d):
    samples = table(spark, d, "samples").select("sample_id", F.col("rel_path").alias("relative_path"))
    manifest = table(spark, d, "samples").filter("augmentation_depth = 0 and split is not null").groupBy(F.col("rel_path").alias("relative_path")).agg(F.min(clean.bare(F.col("split"))).alias("split"))
    return lineage.split_from_manifest(samples, manifest).select("sample_id", "split")


def split_counts(spark, d):
    return split_assign_directory(spark, d).groupBy("split").agg(F.count("*").alias("n"))


def _edges(spark, d):
    """region > nation > customer > orders as lineage."""
    pair = lambda df, c, p: df.select(c.alias("child"), p.alias("parent"))
    key = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    nation, customer, orders = (table(spark, d, x) for x in ("nation", "customer", "orders"))
    return pair(nation, key("n", "n_nationkey"), key("r", "n_regionkey")).union(pair(customer, key("c", "c_custkey"), key("n", "c_nationkey"))).union(pair(orders, key("o", "o_orderkey"), key("c", "o_custkey")))


EDGES_SQL = """edges AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


def lineage_ancestors(spark, d):
    edges = _edges(spark, d)
    return lineage.ancestors(edges, edges.select(F.col("child").alias("id")))


def split_leakage(spark, d):
    samples = table(spark, d, "samples")
    edges = samples.filter("source_sample_id is not null").select(F.col("sample_id").alias("child"), F.col("source_sample_id").alias("parent")).distinct()
    nodes = samples.select(F.col("sample_id").alias("id"), clean.split_name(F.col("split")).alias("split")).distinct()
    return lineage.split_leaks(edges, nodes)


def root_in_many_splits(spark, d):
    samples = table(spark, d, "samples").select(F.coalesce("source_sample_id", "sample_id").alias("root"), clean.split_name(F.col("split")).alias("split"))
    return lineage.roots_in_many_splits(samples)


def content_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


def exact_duplicates(spark, d):
    return dedup.exact_groups(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id").withColumnRenamed("first_item", "first_doc")


def sample_identity(spark, d):
    return table(spark, d, "samples").select("rel_path", "root_digest").distinct().select("rel_path", identity.sample_id(F.col("root_digest"), F.concat(F.lit("./"), F.col("rel_path"))).alias("id"))


def object_identity(spark, d):
    made = identity.object_id(F.sha2(F.col("sample_id").cast("string"), 256), F.lit(0), F.col("class_name"), g.box(), F.col("score"))
    return detections(spark, d).select("object_id", made.alias("id"))


def candidate_identity(spark, d):
    return table(spark, d, "candidates").select("sample_id", "target_object_id", "candidate_key").distinct().select("sample_id", "target_object_id", "candidate_key", identity.candidate_id(*map(F.col, ("sample_id", "target_object_id", "candidate_key"))).alias("id"))


def ahash_raster(spark, d):
    return rasters(spark, d).select("id", dedup.average_hash(F.col("pixels")).alias("hash"))


def _coarse(spark, d):
    """Hashes of which many lie near each other: the average hash of the label's first raster with a few bits of the own one."""
    hashed = rasters(spark, d).select("id", "label", dedup.average_hash(F.col("pixels")).alias("hash"))
    base = hashed.groupBy("label").agg(F.min_by("hash", "id").alias("base"))
    return hashed.join(base, "label").select("id", F.col("base").bitwiseXOR(F.col("hash").bitwiseAND(F.lit(0x1041041041))).alias("hash"))


COARSE_SQL = """px AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS p FROM embeddings),
bits AS (SELECT id, label, list_sum([v / 64 FOR v IN p]) AS mean, p FROM px),
hashed AS (SELECT id, label, list_reduce(list_concat([0::UBIGINT], [CASE WHEN v > list_sum(p) / 64 THEN 1::UBIGINT ELSE 0::UBIGINT END FOR v IN p]), lambda a, b: (a % 9223372036854775808::UBIGINT) * 2 + b) AS hash FROM bits),
base AS (SELECT label, arg_min(hash, id) AS base FROM hashed GROUP BY label),
coarse AS (SELECT id, xor(base, hash & 69810262081::UBIGINT) AS hash FROM hashed JOIN base USING (label))"""


def near_duplicate_pairs(spark, d):
    hashes = _coarse(spark, d)
    pairs = dedup.hash_pairs(hashes, 3)
    counts = hashes.groupBy("hash").agg(F.count("*").alias("n"))
    met = pairs.join(counts.withColumnRenamed("hash", "a").withColumnRenamed("n", "na"), "a").join(counts.withColumnRenamed("hash", "b").withColumnRenamed("n", "nb"), "b")
    return met.groupBy("distance").agg(F.count("*").alias("value_pairs"), F.sum(F.col("na") * F.col("nb")).alias("row_pairs"))


def near_duplicate_greedy(spark, d):
    rows = _coarse(spark, d)
    return dedup.resolve(rows.select(F.col("id").alias("item"), F.col("id").alias("ord"), "hash"), None, 3)


def cosine_duplicates(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return dedup.cosine_matches(vectors.filter("id % 50 = 0"), vectors, 0.35).filter("query <> item").select("query", "item", F.round("similarity", 6).alias("similarity"))


_SCORED = "SELECT *, CASE WHEN class_name NOT IN ('A', 'R') THEN 'class' WHEN score < 0.7 THEN 'score' WHEN area < 2000 THEN 'area' END AS why FROM det"
_OTHER = "o.object_id AS o_id, o.y_max AS o_y_max, greatest(least(t.x_max, o.x_max) - greatest(t.x_min, o.x_min), 0) * greatest(least(t.y_max, o.y_max) - greatest(t.y_min, o.y_min), 0) AS shared, (t.x_max - t.x_min) * (t.y_max - t.y_min) AS ta, (o.x_max - o.x_min) * (o.y_max - o.y_min) AS oa"
_MET = f"{WITH}, met AS (SELECT t.sample_id, t.object_id, t.class_name, t.y_max, o.class_name AS o_class, {_OTHER} FROM det t JOIN det o USING (sample_id) WHERE t.class_name = 'A' AND t.score >= 0.9), pair AS (SELECT *, round(shared / (ta + oa - shared), 9) AS iou FROM met)"
_ASPECT = "(x_max - x_min) / (y_max - y_min)"
_SIZE = "CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' WHEN area < 50176 THEN 'large' ELSE 'huge' END"
_ASPECTS = f"CASE WHEN {_ASPECT} <= 0 THEN 'unknown' WHEN {_ASPECT} < 0.5 THEN 'tall' WHEN {_ASPECT} < 0.9 THEN 'portrait' WHEN {_ASPECT} <= 1.1 THEN 'square' WHEN {_ASPECT} <= 2 THEN 'landscape' ELSE 'wide' END"
_SCALE = "CASE WHEN area / 480000.0::DOUBLE < 0.01 THEN 'tiny' WHEN area / 480000.0::DOUBLE < 0.05 THEN 'small' WHEN area / 480000.0::DOUBLE < 0.2 THEN 'medium' ELSE 'large' END"
_CANON = "CASE WHEN lower({0}) IN ('train', 'training') THEN 'train' WHEN lower({0}) IN ('val', 'valid', 'validation') THEN 'val' WHEN lower({0}) IN ('test', 'testing') THEN 'test' END"
_BARE = r"lower(regexp_replace({0}, '^[\s\pZ\pC]+|[\s\pZ\pC]+$', '', 'g'))"
_SPLIT = f"CASE WHEN {_BARE.format('split')} IN ('train', 'training') THEN 'train' WHEN {_BARE.format('split')} IN ('val', 'valid', 'validation') THEN 'validation' WHEN {_BARE.format('split')} IN ('test', 'testing') THEN 'test' END"
_DIRECTORY = f"SELECT sample_id, coalesce(list_extract([s FOR s IN [{_CANON.format('p')} FOR p IN string_split(rel_path, '/')[:-2]] IF s IS NOT NULL], 1), 'unassigned') AS split FROM samples"
_STEM = "lower(split || '_' || sample_id)"
_NAMES = " ".join(f"WHEN starts_with({_STEM}, '{k}') OR contains({_STEM}, '_{k}') THEN '{v}'" for k, v in lineage.SPLITS.items())
_Q = lambda e: f"(CASE WHEN round_even({e} / 2, 0) * 2 = 0 THEN 0.0::DOUBLE ELSE round_even({e} / 2, 0) * 2 END)"
_JSON = "replace(replace({0}, '\\', '\\\\'), '\"', '\\\"')"

FUNCTIONS = [select_targets_topk, select_targets_largest, selection_drop_counters, best_match_iou, nearest_neighbours, occlusion_relations, bbox_geometry, box_clip_normalise, polygon_area, size_buckets, aspect_buckets, scale_class, distribution_histograms, dataset_inspect]
FUNCTIONS += [split_assign_directory, split_assign_filename, split_assign_manifest, split_counts, lineage_ancestors, split_leakage, root_in_many_splits, content_digest, exact_duplicates, sample_identity, object_identity, candidate_identity, ahash_raster, near_duplicate_pairs, near_duplicate_greedy, cosine_duplicates]
QUERIES = {f.__name__: f for f in FUNCTIONS}
SQL = {
    "select_targets_topk": f"{WITH} SELECT sample_id, object_id, CAST(r - 1 AS INTEGER) AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, object_id) AS r FROM ({_SCORED}) WHERE why IS NULL) WHERE r <= 2",
    "select_targets_largest": f"{WITH} SELECT sample_id, object_id, area FROM ({_SCORED}) WHERE why IS NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY area DESC, object_id) = 1",
    "selection_drop_counters": f"""{WITH} SELECT sample_id, count(*) AS n_objects, count(*) FILTER (why = 'class') AS dropped_class, count(*) FILTER (why = 'score') AS dropped_score, count(*) FILTER (why = 'area') AS dropped_area,
  greatest(count(*) FILTER (why IS NULL) - 2, 0) AS dropped_cap, least(count(*) FILTER (why IS NULL), 2) AS selected FROM ({_SCORED}) GROUP BY sample_id""",
    "best_match_iou": f"""{_MET}, best AS (SELECT sample_id, object_id, o_id AS match_id, iou FROM pair WHERE o_class <> 'A' AND iou >= 0.05 QUALIFY row_number() OVER (PARTITION BY sample_id, object_id ORDER BY iou DESC, o_id) = 1)
SELECT t.sample_id, t.object_id, match_id, iou, match_id IS NOT NULL AS found FROM det t LEFT JOIN best USING (sample_id, object_id) WHERE t.class_name = 'A' AND t.score >= 0.9""",
    "nearest_neighbours": f"{_MET} SELECT sample_id, object_id, o_id AS neighbour_id, iou, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, object_id ORDER BY iou DESC, o_id) AS rank FROM pair WHERE object_id <> o_id) WHERE rank <= 8",
    "occlusion_relations": f"""{_MET}, f AS (SELECT *, round(least(shared / least(ta, oa), 1), 9) AS overlap_fraction FROM pair WHERE object_id <> o_id)
SELECT sample_id, object_id, o_id AS other_id, CASE WHEN overlap_fraction <= 0 THEN 'adjacent' WHEN overlap_fraction < 0.5 THEN 'overlapping' WHEN o_y_max > y_max THEN 'in_front_of' ELSE 'behind' END AS relation, overlap_fraction FROM f""",
    "bbox_geometry": f"{WITH} SELECT object_id, x_max - x_min AS width, y_max - y_min AS height, (x_max - x_min) * (y_max - y_min) AS box_area, round({_ASPECT}, 6) AS aspect, (x_min + x_max) / 2 AS cx, (y_min + y_max) / 2 AS cy, 300 BETWEEN x_min AND x_max AND 200 BETWEEN y_min AND y_max AS holds_point FROM det",
    "box_clip_normalise": f"{WITH} SELECT object_id, round(greatest(least(x_min - 10, 800), 0) / 800, 6) AS x_min, round(greatest(least(y_min - 10, 600), 0) / 600, 6) AS y_min, round(least(greatest(x_max + 10, 0), 800) / 800, 6) AS x_max, round(least(greatest(y_max + 10, 0), 600) / 600, 6) AS y_max FROM det",
    "polygon_area": f"{WITH} SELECT object_id, round((x_max - x_min) * (y_max - y_min) / 2 - (x_max - x_min) * (y_max - y_min) / 8, 6) AS polygon_area FROM det",
    "size_buckets": f"{WITH} SELECT {_SIZE} AS size_bucket, count(*) AS n FROM det GROUP BY 1",
    "aspect_buckets": f"{WITH} SELECT {_ASPECTS} AS aspect_bucket, count(*) AS n FROM det GROUP BY 1",
    "scale_class": f"{WITH} SELECT {_SCALE} AS scale_class, count(*) AS n FROM det GROUP BY 1",
    "distribution_histograms": f"""{WITH} SELECT 'class_name' AS dimension, class_name AS bucket, count(*) AS n FROM det GROUP BY ALL UNION ALL SELECT 'size_bucket', {_SIZE}, count(*) FROM det GROUP BY ALL
  UNION ALL SELECT 'aspect_bucket', {_ASPECTS}, count(*) FROM det GROUP BY ALL UNION ALL SELECT 'scale_class', {_SCALE}, count(*) FROM det GROUP BY ALL""",
    "dataset_inspect": f"{WITH} SELECT class_name, count(*) AS objects, count(DISTINCT sample_id) AS samples, max(x_max - x_min) AS widest, max(y_max - y_min) AS highest FROM det GROUP BY 1",
    "split_assign_directory": _DIRECTORY,
    "split_assign_filename": f"SELECT sample_id, CASE {_NAMES} ELSE 'unassigned' END AS split FROM samples WHERE split IS NOT NULL",
    "split_assign_manifest": f"WITH m AS (SELECT rel_path, min({_BARE.format('split')}) AS s FROM samples WHERE augmentation_depth = 0 AND split IS NOT NULL GROUP BY rel_path) SELECT sample_id, coalesce({_CANON.format('s')}, 'unassigned') AS split FROM samples LEFT JOIN m USING (rel_path)",
    "split_counts": f"SELECT split, count(*) AS n FROM ({_DIRECTORY}) GROUP BY split",
    "lineage_ancestors": f"WITH RECURSIVE {EDGES_SQL}, up AS (SELECT child AS id, parent AS ancestor, 1 AS depth FROM edges UNION ALL SELECT up.id, e.parent, up.depth + 1 FROM up JOIN edges e ON up.ancestor = e.child) SELECT id, ancestor, min(depth) AS depth FROM up GROUP BY id, ancestor",
    "split_leakage": f"WITH n AS (SELECT DISTINCT sample_id AS id, {_SPLIT} AS split FROM samples), e AS (SELECT DISTINCT sample_id AS child, source_sample_id AS parent FROM samples WHERE source_sample_id IS NOT NULL) SELECT child, parent, c.split AS child_split, p.split AS parent_split FROM e JOIN n c ON c.id = child JOIN n p ON p.id = parent WHERE c.split <> p.split",
    "root_in_many_splits": f"SELECT coalesce(source_sample_id, sample_id) AS root, count(DISTINCT {_SPLIT}) AS n_splits, count(*) AS n_samples FROM samples GROUP BY 1 HAVING n_splits > 1",
    "content_digest": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "exact_duplicates": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING n > 1",
    "sample_identity": f"SELECT DISTINCT rel_path, 's_' || substr(sha256('{{\"path\":\"' || {_JSON.format('rel_path')} || '\",\"root\":\"' || root_digest || '\"}}'), 1, 16) AS id FROM samples",
    "object_identity": f"""{WITH} SELECT object_id, 'o_' || substr(sha256('{{"asset":"' || sha256(CAST(sample_id AS VARCHAR)) || '","box":[' || concat_ws(',', {_Q('x_min')}, {_Q('y_min')}, {_Q('x_max')}, {_Q('y_max')}) || '],"class":"' || class_name || '","frame":0,"score":' ||
  CAST(round_even(score / 0.05::DOUBLE, 0) * 0.05::DOUBLE AS VARCHAR) || '}}'), 1, 12) AS id FROM det""",
    "candidate_identity": "SELECT DISTINCT sample_id, target_object_id, candidate_key, 'c_' || substr(sha256('{\"key\":\"' || candidate_key || '\",\"object\":\"' || target_object_id || '\",\"sample\":\"' || sample_id || '\"}'), 1, 16) AS id FROM candidates",
    "ahash_raster": f"WITH {COARSE_SQL} SELECT id, CASE WHEN hash > 9223372036854775807 THEN CAST(hash::HUGEINT - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(hash AS BIGINT) END AS hash FROM hashed",
    "near_duplicate_pairs": f"WITH {COARSE_SQL}, v AS (SELECT hash, count(*) AS n FROM coarse GROUP BY hash) SELECT CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance, count(*) AS value_pairs, CAST(sum(a.n * b.n) AS BIGINT) AS row_pairs FROM v a JOIN v b ON a.hash < b.hash WHERE bit_count(xor(a.hash, b.hash)) <= 3 GROUP BY 1",
    # One record after the other: a list of the hashes that were kept so far.
    "near_duplicate_greedy": f"""WITH RECURSIVE {COARSE_SQL}, o AS (SELECT id, hash, row_number() OVER (ORDER BY id) AS k FROM coarse),
step AS (SELECT 0::BIGINT AS k, []::UBIGINT[] AS held, false AS kept UNION ALL SELECT o.k, CASE WHEN n = 0 THEN list_append(held, hash) ELSE held END, n = 0
  FROM (SELECT o.*, held, len([1 FOR x IN held IF bit_count(xor(x, o.hash)) <= 3]) AS n FROM step JOIN o ON o.k = step.k + 1) o),
done AS (SELECT id, hash, o.k, kept FROM o JOIN step USING (k)),
best AS (SELECT d.id, min(struct_pack(distance := bit_count(xor(d.hash, e.hash))::INTEGER, since := e.id)) AS m FROM done d JOIN done e ON e.kept AND e.k < d.k AND bit_count(xor(d.hash, e.hash)) <= 3 GROUP BY d.id)
SELECT d.id AS item, kept, CASE WHEN m IS NULL THEN 'unique' WHEN m.distance = 0 THEN 'exact' ELSE 'near' END AS kind, m.since AS reference, m.distance AS distance FROM done d LEFT JOIN best USING (id)""",
    "cosine_duplicates": "SELECT q.vec_id AS query, i.vec_id AS item, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0 AND list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) >= 0.35",
}
