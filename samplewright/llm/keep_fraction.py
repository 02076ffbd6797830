"""Problem 2: the score cutoff of each category that keeps a target fraction.

Sketch-bracketed exact selection. A quantile summary with guaranteed rank bounds brackets the
wanted rank of every category, one pass counts what lies above the bracket and groups what lies
inside by value, and only those bracketed values are sorted. If a bracket still holds too many
distinct values for one task, the summary is taken again of the bracket alone.

Defined cases: a category compares in lower case with blanks and underscores as hyphens; null
categories, and categories without a target, keep nothing; scores outside [0, 1], null and NaN
are no scores; ties with the cutoff are all kept; a target of 0, below 0 or null keeps nothing,
one above 1000 keeps all; of several targets for one category the highest holds; candidates
without an id are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from samplewright.functions import clean
from samplewright.llm.tables import latest
from samplewright.session import lookup_join, settle

#: Steps of the percentile grid and accuracy of the summary; a bracket spans few steps.
GRID, ACCURACY = 100, 2000
#: Distinct bracketed values that one task may sort; beyond it the bracket is narrowed again.
SORT_VALUES = 500_000


def scored_candidates(candidates: DataFrame) -> DataFrame:
    """Current candidates with a category and a score: ``cid, cat, s``."""
    rows = latest(candidates, ["candidate_id"], [F.col("updated_at")], {"cat": clean.category(F.col("category")), "s": clean.score(F.col("overall_score"))})
    return rows.filter(F.col("s").isNotNull() & F.col("cat").isNotNull()).withColumnRenamed("candidate_id", "cid")


def settled_candidates(candidates: DataFrame) -> DataFrame:
    """The same, stored once for the passes that follow."""
    return settle(scored_candidates(candidates), "p2-scored")


def _targets(keep_targets: DataFrame) -> DataFrame:
    permille = F.least(F.col("keep_permille").cast("bigint"), F.lit(1000))
    # Nulls go first: least() would read them as 1000.
    return keep_targets.filter("keep_permille > 0").select(clean.category(F.col("category")).alias("cat"), permille.alias("permille")).filter("cat is not null").groupBy("cat").agg(F.max("permille").alias("permille"))


def _grid(inside: DataFrame) -> DataFrame:
    points = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return inside.groupBy("cat").agg(F.count("*").alias("n"), F.percentile_approx("s", points, ACCURACY).alias("grid"))


def cutoffs(scored: DataFrame, keep_targets: DataFrame, sort_values: int = SORT_VALUES) -> DataFrame:
    """``cat, n, k, cutoff, kept`` for every category that has a target and a score."""
    spread = F.col("cid")
    wanted = _grid(scored).join(_targets(keep_targets), "cat").withColumn("k", F.expr("(n * permille + 999) div 1000"))
    #: above: records known to lie over the bracket; need: wanted rank from the bracket's top.
    state = wanted.select("cat", "k", F.col("n").alias("all"), F.lit(0).cast("bigint").alias("above"), "n", "grid")
    base, margin, lo0, hi0 = scored, 1, None, None
    while True:
        # The rank from below is (n - need + 1) of n; the summary errs by n / ACCURACY at most, under a tenth of a step.
        place = (F.col("n") - (F.col("k") - F.col("above")) + 1) / F.col("n") * GRID
        at = lambda i: F.element_at("grid", (i + 1).cast("int"))
        low, high = F.floor(place) - margin, F.ceil(place) + margin
        brackets = state.select(
            "cat", "k", "all", "above",
            F.when(low >= 0, at(F.greatest(low, F.lit(0)))).otherwise(F.lit(float("-inf"))).alias("lo"),
            F.when(high <= GRID, at(F.least(high, F.lit(GRID)))).otherwise(F.lit(float("inf"))).alias("hi"),
        )
        brackets = settle(brackets, "p2-brackets")
        marked = lookup_join(base, brackets, ["cat"], spread).filter("s >= lo")
        values = marked.groupBy("cat", F.when(F.col("s") <= F.col("hi"), F.col("s")).alias("v")).agg(F.count("*").alias("c"))
        values = settle(values, "p2-values")
        sums = values.groupBy("cat").agg(F.sum(F.when(F.col("v").isNull(), F.col("c"))).alias("over"), F.sum(F.when(F.col("v").isNotNull(), F.col("c"))).alias("within"), F.count("v").alias("distinct"))
        sums = brackets.join(sums, "cat", "left").select("cat", "k", "all", "lo", "hi", (F.col("above") + F.coalesce("over", F.lit(0))).alias("above"), F.coalesce("within", F.lit(0)).alias("within"), F.coalesce("distinct", F.lit(0)).alias("distinct"))
        missed, widest = sums.agg(F.count_if((F.col("k") <= F.col("above")) | (F.col("k") > F.col("above") + F.col("within"))), F.max("distinct")).first()
        if missed:  # outside the guaranteed bounds: widen, which ends at the whole range
            margin *= 4
            continue
        if (widest or 0) <= sort_values:
            break
        base = settle(lookup_join(base, sums.select("cat", "lo", "hi"), ["cat"], spread).filter("s between lo and hi").select("cid", "cat", "s"), "p2-inside")
        state = sums.select("cat", "k", "all", "above").join(_grid(base), "cat")
        margin = 1
    ordered = W.partitionBy("cat").orderBy(F.col("v").desc()).rowsBetween(W.unboundedPreceding, 0)
    run = values.filter("v is not null").join(sums.select("cat", "k", "all", "above"), "cat").withColumn("kept", F.col("above") + F.sum("c").over(ordered))
    return run.filter("kept >= k and kept - c < k").select("cat", F.col("all").alias("n"), "k", F.col("v").alias("cutoff"), "kept")


def kept(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """The candidates at or above the cutoff of their category."""
    return lookup_join(scored, cuts.select("cat", "cutoff"), ["cat"], F.col("cid")).filter("s >= cutoff").select(F.col("cat").alias("category"), F.col("cid").alias("candidate_id"))
