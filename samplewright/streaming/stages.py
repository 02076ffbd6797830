"""Stateless stages over streams, and the two stateful ones that a live run needs.

Selection per arriving sample, gates and report rows are plain projections and run unchanged under ``readStream``. State is kept for counting by event time and for a rate budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from samplewright.operators import gates


def decide_stream(evidence: DataFrame, policy: gates.Policy) -> DataFrame:
    """Decisions on a stream of wide evidence rows; the same plan as in batch."""
    return gates.decide(evidence, policy)


def acceptance_windows(decided: DataFrame, at: str = "decided_at", by: str = "category", size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per event-time window and category; rows later than the watermark are left out."""
    count = lambda s: F.sum(F.when(F.col("decision") == s, 1).otherwise(0))
    grouped = decided.withWatermark(at, late).groupBy(F.window(at, size), by)
    return grouped.agg(F.count("*").alias("n"), count("accepted").alias("accepted"), count("rejected").alias("rejected"), count("needs_review").alias("review")).select(F.col("window.start").alias("window_start"), by, "n", "accepted", "rejected", "review")


def rate_budget(requests: DataFrame, limit: int, period_s: float, backend: str = "backend_id", at: str = "requested_at") -> DataFrame:
    """When each request of a backend may start: at most ``limit`` starts in any period.

    Rows ``request_id``, backend and time; gives ``request_id``, the backend, ``start_at``. Only the last ``limit`` starts are kept per backend.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([at, "request_id"])
        out = []
        for request, when in zip(rows["request_id"], rows[at], strict=True):
            moment = when.timestamp()
            if len(starts) >= limit:
                moment = max(moment, starts[-limit] + period_s)
            starts = [*starts, moment][-limit:]
            out.append((request, key[0], pd.Timestamp(moment, unit="s")))
        state.update((starts,))
        yield pd.DataFrame(out, columns=["request_id", backend, "start_at"])

    return requests.groupBy(backend).applyInPandasWithState(run, f"request_id string, {backend} string, start_at timestamp", "starts array<double>", "append", GroupStateTimeout.NoTimeout)


def first_seen(rows: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream whose key was not seen within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key)
