"""Splits, leakage over lineage edges, and ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.session import settle

# Spellings of the splits, in the order in which a file name is tried.
SPLITS = {"validation": "val", "valid": "val", "val": "val", "testing": "test", "test": "test", "training": "train", "train": "train"}


def canonical(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for spelling, split in SPLITS.items():
        out = F.when(F.lower(name) == spelling, split).otherwise(out)
    return out


def split_from_directory(path: Column, default: str = "unassigned") -> Column:
    """The first directory of the path that names a split."""
    named = F.filter(F.transform(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), canonical), lambda s: s.isNotNull())
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(default))


def split_from_filename(path: Column, default: str = "unassigned") -> Column:
    """The first spelling that starts the stem or follows an underscore in it."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
    out = F.lit(default)
    for spelling, split in reversed(SPLITS.items()):
        out = F.when(stem.startswith(spelling) | stem.contains(f"_{spelling}"), split).otherwise(out)
    return out


def split_from_manifest(samples: DataFrame, manifest: DataFrame, default: str = "unassigned") -> DataFrame:
    """``split`` from rows ``relative_path, split`` of a manifest."""
    named = manifest.select("relative_path", canonical(F.col("split")).alias("split"))
    return samples.drop("split").join(named, "relative_path", "left").withColumn("split", F.coalesce("split", F.lit(default)))


def split_leaks(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Edges whose child and parent stand in different splits; edges ``child, parent``, samples ``id, split``."""
    child = samples.select(F.col("id").alias("child"), F.col("split").alias("child_split"))
    parent = samples.select(F.col("id").alias("parent"), F.col("split").alias("parent_split"))
    return edges.join(child, "child").join(parent, "parent").filter("child_split <> parent_split").select("child", "parent", "child_split", "parent_split")


def roots_in_many_splits(samples: DataFrame, root: str = "root") -> DataFrame:
    """Lineage roots whose samples stand in more than one split."""
    return samples.filter(F.col(root).isNotNull()).groupBy(root).agg(F.countDistinct("split").alias("n_splits"), F.count("*").alias("n_samples")).filter("n_splits > 1")


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``id, ancestor, depth`` of every transitive parent, by the shortest way, for the ids of ``start``.

    One join a generation on stored rows, however long the chain; ends when a generation adds nothing, so a cycle ends it too.
    """
    seen = settle(edges.join(start.select(F.col("id").alias("child")).distinct(), "child", "left_semi").select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "lineage")
    front, depth = seen, 1
    while True:
        depth += 1
        step = front.join(edges, front["ancestor"] == edges["child"]).select("id", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        front = settle(step.join(seen.select("id", "ancestor"), ["id", "ancestor"], "left_anti"), "lineage")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if depth % 32 == 0:  # else the plan of a long chain becomes a union of as many tables
            seen = settle(seen, "lineage")


ANCESTORS_SQL = """WITH RECURSIVE up AS (
  SELECT child AS id, parent AS ancestor, 1 AS depth FROM {edges}
  UNION ALL SELECT up.id, e.parent, up.depth + 1 FROM up JOIN {edges} e ON up.ancestor = e.child WHERE up.depth < {longest})
SELECT id, ancestor, min(depth) AS depth FROM up GROUP BY id, ancestor"""


def protected_splits_allowed(augment: list[str], opted_in: bool, strict: bool) -> list[str]:
    """Errors of a split policy: validation and test need an explicit opt-in, and are never augmented in strict mode."""
    guarded = [s for s in augment if s in ("val", "test")]
    if guarded and strict:
        return [f"split {s} cannot be augmented in strict mode" for s in guarded]
    return [] if opted_in or not guarded else [f"split {s} needs an explicit opt-in" for s in guarded]
