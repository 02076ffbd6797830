"""Derived seeds: a tree of labels below one root seed, so that siblings cannot be guessed from each other."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def derive(parent: int, *labels: object) -> int:
    """The seed below ``parent`` at a path of labels: keyed BLAKE2b (this engine's own key), 63 bits."""
    material = "\0".join(map(str, (parent, *labels))).encode()
    return int.from_bytes(hashlib.blake2b(material, digest_size=8, person=b"smplwrght").digest(), "big") >> 1


def derive_column(parent: int, *labels: Column) -> Column:
    """:func:`derive` for a column of label paths."""

    def run(paths: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else derive(parent, *p) for p in paths], dtype="Int64")

    return F.pandas_udf(run, "bigint")(F.array(*[c.cast("string") for c in labels]))
