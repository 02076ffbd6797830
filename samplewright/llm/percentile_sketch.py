"""Problem 5: percentiles of large numeric columns from sketches that can be joined.

A sketch is a hierarchy of randomized compactors (KLL): a full level is sorted and every other
value, from a random start, moves up with twice the weight; two sketches merge level by level.
Spark evaluates it in the JVM with partial aggregation, so a hot group sends one sketch a task.
One sketch is kept for each operator, backend and day; days are merged for the whole period.

Error: a percentile's rank is off by at most ``rank_error(k)`` of the values with 99 % probability;
groups of fewer than k values are exact.

Defined cases: only current node runs count (highest attempt; ties to the latest row); rows with
status other than succeeded, cache hits, null or negative durations, and null backend_id or
started_at are left out; a null operator forms its own group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import clean
from samplewright.llm.tables import latest
from samplewright.session import settle

#: Size parameter of the compactors.
K = 400


def rank_error(k: int = K) -> float:
    """Bound on the normalised rank error of one percentile, at 99 % confidence (the library's published fit)."""
    return 2.296 / k**0.9723


def counted_runs(node_runs: DataFrame) -> DataFrame:
    """``operator, backend_id, run_day, duration_ms`` of the runs that count."""
    usable = (clean.bare(F.col("status")) == "succeeded") & (F.col("cache_hit") == 0) & (F.col("duration_ms") >= 0) & F.col("backend_id").isNotNull() & F.col("started_at").isNotNull()
    # The values of a row that does not count are emptied before the shuffle; the row itself must still outrank earlier attempts.
    runs = latest(
        node_runs,
        ["job_id", "node_id"],
        [F.col("attempt")],
        {"duration_ms": F.when(usable, F.col("duration_ms").cast("bigint")), "run_day": F.when(usable, F.col("started_at").cast("date")), "operator": F.when(usable, F.col("operator")), "backend_id": F.when(usable, F.col("backend_id"))},
    )
    return runs.filter("duration_ms is not null").select("operator", "backend_id", "run_day", "duration_ms")


def daily_sketches(runs: DataFrame, k: int = K) -> DataFrame:
    """One sketch for each operator, backend and day; store these and add a day at a time."""
    return runs.groupBy("operator", "backend_id", "run_day").agg(F.count("*").alias("n"), F.expr(f"kll_sketch_agg_bigint(duration_ms, {k})").alias("sketch"))


def merged_sketches(daily: DataFrame, k: int = K) -> DataFrame:
    """Sketches of the whole period from daily ones."""
    return daily.groupBy("operator", "backend_id").agg(F.sum("n").alias("n"), F.expr(f"kll_merge_agg_bigint(sketch, {k})").alias("sketch"))


def percentile(sketch: str, rank: float) -> F.Column:
    """The smallest value that at least ``rank`` of the values do not exceed."""
    return F.expr(f"kll_sketch_get_quantile_bigint({sketch}, CAST({rank} AS DOUBLE))")


def percentiles(daily: DataFrame, k: int = K, ranks: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Percentiles of every operator and backend over all days, with the stated error."""
    return merged_sketches(daily, k).select("operator", "backend_id", "n", *[percentile("sketch", r).alias(f"p{r * 100:g}".replace(".", "_")) for r in ranks], F.lit(rank_error(k)).alias("rank_error"))


def slow_days(node_runs: DataFrame, k: int = K, least: int = 12, factor: int = 2) -> DataFrame:
    """Days whose median is more than ``factor`` times the median of all days, by ``least`` runs or more."""
    daily = settle(daily_sketches(counted_runs(node_runs), k), "p5-daily")
    whole = merged_sketches(daily, k).select(F.col("operator").alias("o"), F.col("backend_id").alias("b"), percentile("sketch", 0.5).alias("all_median"))
    days = daily.filter(F.col("n") >= least).withColumn("median", percentile("sketch", 0.5))
    found = days.join(whole, F.col("operator").eqNullSafe(F.col("o")) & (F.col("backend_id") == F.col("b"))).filter(F.col("median") > factor * F.col("all_median"))
    return found.select("operator", "backend_id", F.col("run_day").cast("string").alias("run_day"))
