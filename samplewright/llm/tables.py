"""Current rows of the versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: dict[str, Column]) -> DataFrame:
    """The row of each key with the highest ``order``; repeated rows count once.

    Ties in ``order`` fall to the highest kept values, so the choice is the same on every run. Rows
    without a key are left out. The maximum is combined map-side, so a key that was sent very often costs one row a task.
    """
    named = df.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)],
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(f"v{i}") for i, c in enumerate(keep.values())]).alias("__row"),
    )
    for i in range(len(key)):
        named = named.filter(F.col(f"__k{i}").isNotNull())
    best = named.groupBy(*[f"__k{i}" for i in range(len(key))]).agg(F.max("__row").alias("__row"))
    return best.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(key)], *[F.col(f"__row.v{i}").alias(n) for i, n in enumerate(keep)])
