"""Problem 3: records of evaluation splits that also appear in the training split.

Perceptual hashes are sets of 64 shingles, one (position, digit) for each binary digit, of 128 possible ones. A set's
minwise hashes under seeded random permutations of the 128 shingles are laid into bands (:mod:`minwise`); only training and
evaluation values that share a band are compared, and each such pair is verified by its exact Jaccard similarity. Two sets whose hashes differ
in d bits share 64 - d of 64 + d shingles, so "at most 6 bits" is a similarity of 58/70 or more. Bands are chosen
so that a pair right at that limit is missed with a probability of MISS at most; nearer pairs are missed far more seldom.

Content digests are no sets: two are equal or not. They are joined on their first 16 hexadecimal digits and tested for a prefix.

All of this runs on distinct values. Confirmed value pairs are then spread into tiles of at most
TILE x TILE records, so a value that a third of all records share becomes many small joins. The report needs no pairs of
records: it counts them from the numbers of records per value, by inclusion and exclusion.

Defined cases: splits other than the training and evaluation names take no part; missing or
unreadable values equal nothing; repeated records count once (the latest by created_at); records
without an id are left out; a pair is given once however many of the three values agree; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.functions import clean, segments
from samplewright.llm import minwise
from samplewright.llm.tables import latest
from samplewright.session import settle, shuffled, sweep

#: Records of one value in one tile.
TILE = 1000
#: Shingles shared of shingles held, for hashes with 6 of 64 bits differing.
SHARED, UNION = 58, 70
#: Probability at most of missing a pair of just that similarity.
MISS = 1e-6
#: Rows of values and bands that are shuffled at once, and into how many runs the bands are cut for that at most.
AT_ONCE, RUNS = 32_000_000, 8
VALUES = ("source", "output", "h")


def records(provenance: DataFrame, candidates: DataFrame) -> DataFrame:
    """``id, split, source, output, h`` with one row a record of a training or evaluation split."""
    rows = latest(provenance, ["candidate_id"], [F.col("created_at")], {"split": clean.split_name(F.col("split")), "source": clean.digest(F.col("source_digest")), "h": clean.fingerprint(F.col("perceptual_hash"))}).filter("split is not null")
    outputs = latest(candidates, ["candidate_id"], [F.col("updated_at")], {"output": clean.digest(F.col("output_digest"))}).filter("output is not null")
    return rows.join(shuffled(outputs), "candidate_id", "left").select(F.col("candidate_id").alias("id"), "split", "source", "output", "h")


def _same_digest(a: Column, b: Column) -> Column:
    return F.coalesce(a.startswith(b) | b.startswith(a), F.lit(False))


def _jaccard_reached(a: Column, b: Column) -> Column:
    """Exact Jaccard of the two bit-shingle sets: (64 - d) / (64 + d) >= SHARED / UNION, in whole numbers."""
    d = segments.hamming(a, b)
    return (F.lit(64) - d) * UNION >= (F.lit(64) + d) * SHARED


def _met(train: DataFrame, evaluation: DataFrame, rows: int, bands: int, part: range) -> DataFrame:
    """Training and evaluation hashes ``a, b`` that share one of the bands in ``part`` and reach the similarity."""
    left = minwise.bands(train.select(F.col("value").alias("a")), rows, bands, part=part)
    right = minwise.bands(evaluation.select(F.col("value").alias("b")), rows, bands, part=part)
    return left.join(shuffled(right), "band").filter(_jaccard_reached(F.col("a"), F.col("b"))).select("a", "b").distinct()


def _hash_bands(train: DataFrame, evaluation: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Training and evaluation hashes that share a band and reach the similarity, with their counts.

    Every value is shuffled once for each band. Many values go through some of the bands at a time, so the disk holds that part only.
    """
    held, asked = (side.select(F.count("*").alias("n")).first()["n"] for side in (train, evaluation))
    rows, bands = minwise.banding(held, SHARED / UNION, MISS)
    runs = min(max(math.ceil((held + asked) * bands / at_once), 1), RUNS)
    cuts = [bands * i // runs for i in range(runs + 1)]
    met = []
    for start, stop in zip(cuts, cuts[1:], strict=False):
        met.append(_met(train, evaluation, rows, bands, range(start, stop)))
        if runs > 1:
            met[-1] = settle(met[-1], "p3-met")
            sweep(train.sparkSession)
    met = reduce(DataFrame.unionByName, met).distinct() if runs > 1 else met[0]
    of = lambda side, value, n: shuffled(side.select(F.col("value").alias(value), F.col("n").alias(n)))
    return met.join(of(train, "a", "na"), "a").join(of(evaluation, "b", "nb"), "b").select("a", "b", "na", "nb")


def _digest_buckets(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    left = train.select(F.col("value").alias("a"), F.col("n").alias("na"), F.substring("value", 1, 16).alias("segment"))
    right = evaluation.select(F.col("value").alias("b"), F.col("n").alias("nb"), F.substring("value", 1, 16).alias("segment"))
    return left.join(shuffled(right), "segment").filter(_same_digest(F.col("a"), F.col("b"))).select("a", "b", "na", "nb")


def value_pairs(rows: DataFrame, column: str) -> DataFrame:
    """Confirmed pairs of values over the split boundary: ``a`` (training), ``b`` (evaluation), record counts ``na``, ``nb``."""
    sweep(rows.sparkSession)
    counts = settle(rows.filter(F.col(column).isNotNull()).groupBy((F.col("split") == "train").alias("train"), F.col(column).alias("value")).agg(F.count("*").alias("n")), f"p3-values-{column}")
    train, evaluation = counts.filter("train"), counts.filter("not train")
    return _hash_bands(train, evaluation) if column == "h" else _digest_buckets(train, evaluation)


def _tiles(pairs: DataFrame, rows: DataFrame, column: str, tile: int) -> DataFrame:
    """Record pairs of the value pairs, joined tile by tile."""
    parts = lambda n: F.ceil(F.col(n) / tile).cast("int")
    wide = pairs.select("a", "b", parts("na").alias("pa"), parts("nb").alias("pb")).withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("pa") - 1))).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)))
    of = lambda side, n: F.pmod(F.xxhash64(F.col(f"{side}.id")), F.col(n)).cast("int")
    record = F.struct("id", "split", "source", "output", "h")
    train = rows.filter("split = 'train'").select(F.col(column).alias("a"), record.alias("t"))
    evaluation = rows.filter("split <> 'train'").select(F.col(column).alias("b"), record.alias("e"))
    # Which tile a record falls into needs only the tile count of its value, a row of the counts.
    counts_a = pairs.groupBy("a").agg(F.max("na").alias("na")).select("a", parts("na").alias("pa"))
    counts_b = pairs.groupBy("b").agg(F.max("nb").alias("nb")).select("b", parts("nb").alias("pb"))
    train = train.join(shuffled(counts_a), "a").select("a", "t", of("t", "pa").alias("ta"))
    evaluation = evaluation.join(shuffled(counts_b), "b").select("b", "e", of("e", "pb").alias("tb"))
    left = wide.select("a", "b", "ta", "tb").join(shuffled(train), ["a", "ta"])
    return left.join(shuffled(evaluation), ["b", "tb"]).select("t", "e")


def pairs(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Every confirmed pair of records as structs ``t`` (training) and ``e`` (evaluation), once."""
    rows = settle(rows, "p3-records")
    out = []
    same_source, same_output = _same_digest(F.col("t.source"), F.col("e.source")), _same_digest(F.col("t.output"), F.col("e.output"))
    for column, unseen in (("source", F.lit(True)), ("output", ~same_source), ("h", ~same_source & ~same_output)):
        known = settle(value_pairs(rows, column), f"p3-{column}")
        sweep(rows.sparkSession)
        out.append(_tiles(known, rows, column, tile).filter(unseen).withColumn("by", F.lit({"h": "hash"}.get(column, column))))
    return reduce(DataFrame.unionByName, out)


def found(provenance: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidate_a, candidate_b`` of every overlapping pair, the smaller id first."""
    t, e = F.col("t.id"), F.col("e.id")
    return pairs(records(provenance, candidates)).select(F.least(t, e).alias("candidate_a"), F.greatest(t, e).alias("candidate_b"))


def report(provenance: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts per evaluation split and source digest: pairs (by the first of source, output and hash that agrees) and records that have one.

    Records whose source digest is missing are counted under a null source. The number of pairs that agree in some of the three values
    is a sum of products of record counts over confirmed value pairs; no pair of records is made.
    """
    rows = settle(records(provenance, candidates), "p3-records")
    near = {c: settle(value_pairs(rows, c).select("a", "b"), f"p3-{c}") for c in VALUES}
    train, evaluation = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    parts = []
    for some in (s for n in (1, 2, 3) for s in combinations(VALUES, n)):
        known = reduce(Column.__and__, [F.col(c).isNotNull() for c in some])
        there = evaluation.filter(known).groupBy("split", *dict.fromkeys(["source", *some])).agg(F.count("*").alias("ne"))
        for c in some:
            there = there.join(shuffled(near[c].select(F.col("b").alias(c), F.col("a").alias(f"a_{c}"))), c)
        here = train.filter(known).groupBy(*[F.col(c).alias(f"a_{c}") for c in some]).agg(F.count("*").alias("nt"))
        n = F.sum(F.col("ne") * F.col("nt"))
        # A pair counts for the last of its values, less those that agree in an earlier one too.
        signed = n * (-1) ** (len(some) - 1)
        parts.append(there.join(shuffled(here), [f"a_{c}" for c in some]).groupBy("split", "source").agg(*[(signed if c == some[-1] else F.lit(0).cast("bigint")).alias(f"by_{c}") for c in VALUES]))
    sums = reduce(DataFrame.unionByName, parts)
    hit = evaluation.select("split", *VALUES)
    for c in VALUES:
        hit = hit.join(shuffled(near[c].select(F.col("b").alias(c)).distinct().withColumn(f"hit_{c}", F.lit(True))), c, "left")
    hit = hit.filter(reduce(Column.__or__, [F.col(f"hit_{c}").isNotNull() for c in VALUES])).groupBy("split", "source").agg(F.count("*").alias("n_records"))
    every = [f"by_{c}" for c in VALUES]
    counted = sums.withColumn("n_records", F.lit(0).cast("bigint")).unionByName(hit.select("split", "source", *[F.lit(0).cast("bigint").alias(c) for c in every], "n_records"))
    counted = counted.groupBy("split", F.col("source").alias("source_digest")).agg(*[F.sum(c).alias(c) for c in [*every, "n_records"]])
    return counted.select("split", "source_digest", reduce(Column.__add__, map(F.col, every)).alias("n_pairs"), "n_records", "by_source", "by_output", F.col("by_h").alias("by_hash"))
