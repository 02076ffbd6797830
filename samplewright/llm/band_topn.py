"""Problem 4: the N highest-scoring items of every group, with an exact tie rule.

Score bands are worked through from the highest. Each band is one range partition of the stored
rows; rows of groups that are already filled are anti-joined away before anything is ranked, the rest is limited to N a group before it is shuffled (so
a group with a third of all rows sends N rows a task), and the boundary
band of a group is finished by an exact ranking of score, then id. The work ends when no group is open.

Defined cases: rows without a score in [0, 1] or without an id do not take part; null group keys
form a group of their own; ties fall to the smallest id; repeated rows count once; groups with
fewer than N rows give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from samplewright.functions import clean
from samplewright.llm.tables import latest
from samplewright.session import BROADCAST_ROWS, at_most, settle

#: Shares of the rows, from the top, at which the bands are cut.
BANDS = (0.3, 0.65)


def top_n(rows: DataFrame, groups: Sequence[str], score: str, item: str, n: int, bands: Sequence[float] = BANDS, cuts: Sequence[float] | None = None) -> DataFrame:
    """``groups``, ``item`` and ``score`` of the first ``n`` rows of each group.

    ``cuts`` are the scores at which bands begin, from the highest; without them they are taken from ``rows``, which are then computed twice. Where
    they lie changes the work and not the result.
    """
    keys = [f"__g{i}" for i in range(len(groups))]
    # 'v' + value or 'n' tells a null from every string, so that anti-join and window hash alike.
    flat = rows.select(*[F.coalesce(F.concat(F.lit("v"), F.col(g).cast("string")), F.lit("n")).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(score).alias("__s"), F.col(item).alias("__i"))
    flat = flat.filter("__s is not null and __i is not null")
    cuts = band_cuts(flat, "__s", bands) if cuts is None else cuts
    band = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        band = F.when(F.col("__s") >= cuts[i], i).otherwise(band)
    first = W.partitionBy(*keys).orderBy(F.col("__s").desc(), F.col("__i"))
    stored = settle(flat.withColumn("__band", band), "p4-bands", ["__band"])
    done: list[DataFrame] = []
    waiting: DataFrame | None = None
    for at in range(len(cuts) + 1):
        new = stored.filter(F.col("__band") == at).select(*keys, "__s", "__i")
        if done:
            filled = reduce(DataFrame.unionByName, [d.filter(F.col("__r") == n).select(*keys) for d in done])
            new = _without(new, filled, keys, first, n)
            if waiting.isEmpty() and new.isEmpty() and _without(stored.filter(F.col("__band") > at), filled, keys, first, n).isEmpty():
                break  # no group is open
            new = waiting.unionByName(new)
        ranked = new.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= n)
        ranked = settle(ranked.withColumn("__n", F.count("*").over(W.partitionBy(*keys))), f"p4-band{at}")
        done.append(ranked.filter(F.col("__n") >= n).select(*keys, "__s", "__i", "__r"))
        waiting = ranked.filter(F.col("__n") < n).select(*keys, "__s", "__i")
    done = [d.drop("__r") for d in done]
    out = reduce(DataFrame.unionByName, [*done, waiting])
    back = [F.when(F.col(k) != "n", F.substring(k, 2, 1 << 30)).cast(rows.schema[g].dataType).alias(g) for g, k in zip(groups, keys, strict=True)]
    return out.select(*back, F.col("__i").alias(item), F.col("__s").alias(score))


def band_cuts(rows: DataFrame, score: str, bands: Sequence[float] = BANDS) -> list[float]:
    """Scores above which about these shares of the rows lie, in descending order; none without scores."""
    return sorted(set(rows.approxQuantile(score, [1 - b for b in bands], 0.02)), reverse=True)


def _without(rows: DataFrame, filled: DataFrame, keys: list[str], first: WindowSpec, n: int) -> DataFrame:
    """Rows of groups that are not filled.

    Few filled groups are broadcast, so their rows end in the scan. With more of them the rows are limited to ``n`` a
    group in each task first; only what is left then meets the filled groups in a shuffle, which the ranking uses again.
    """
    if at_most(filled, BROADCAST_ROWS):
        return rows.join(F.broadcast(filled), keys, "left_anti")
    few = rows.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= n).drop("__r")
    return few.join(filled, keys, "left_anti")


def top_candidates(candidates: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` current candidates of each target object."""
    current = latest(candidates, ["candidate_id"], [F.col("updated_at")], {"sample_id": F.col("sample_id"), "target_object_id": F.col("target_object_id"), "overall_score": clean.score(F.col("overall_score"))})
    cuts = band_cuts(candidates.select(clean.score(F.col("overall_score")).alias("s")), "s")  # of all versions: near enough
    return top_n(current, ["sample_id", "target_object_id"], "overall_score", "candidate_id", n, cuts=cuts)
