"""Minwise hashes of 64-bit strings in bands.

A string of 64 binary digits is the set of its 64 shingles (position, digit), of 128 there are. A minwise hash is the lowest rank that any
of its shingles has in a random permutation of the 128; two sets agree in it with the probability of their Jaccard similarity. Some minwise hashes side
by side are a band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from samplewright.session import parallel

SHINGLES, SEED = 128, 20260301
#: Values whose bands one Arrow batch holds.
_STEP = 4096


def banding(strings: int, similarity: float, miss: float) -> tuple[int, int]:
    """Minwise hashes a band, and bands, for a number of stored strings.

    Random strings agree in a third of their minwise hashes, so bands get longer with the logarithm of ``strings`` and hold about as many of them at every
    size. There are as many bands as leave a pair of just ``similarity`` unmet with a probability of at most ``miss``.
    """
    rows = min(max(math.ceil(math.log(max(strings, 1), 3)) - 2, 3), 18)
    return rows, math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def ranks(functions: int, seed: int = SEED) -> np.ndarray:
    """Seeded permutations as a table [byte of the string, content of the byte, function]: the lowest rank of its eight shingles."""
    shingle = np.random.default_rng(seed).permuted(np.tile(np.arange(SHINGLES, dtype=np.uint8), (functions, 1)), axis=1).reshape(functions, 8, 8, 2)
    digit = np.arange(256)[:, None] >> np.arange(8) & 1
    return np.ascontiguousarray(shingle[:, :, np.arange(8)[None], digit].min(-1).transpose(1, 2, 0))


def signatures(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Minwise hashes [string, function] of 64-bit strings."""
    content = np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8)
    out = table[0][content[:, 0]]
    for i in range(1, 8):
        np.minimum(out, table[i][content[:, i]], out=out)
    return out


def bands(values: DataFrame, rows: int, count: int, seed: int = SEED, part: range | None = None) -> DataFrame:
    """``band, <column>`` for each value of a frame with one BIGINT column; ``band`` is a 64-bit digest of the band's number and content.

    ``part`` takes some of the ``count`` bands only, by their numbers from 0.
    """
    name, part = values.columns[0], range(count) if part is None else part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(ranks(rows * count, seed)[:, :, rows * part.start : rows * part.stop])
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), _STEP):
                some = every[at : at + _STEP]
                parts = signatures(some, table).reshape(len(some), len(part), rows)
                band = np.broadcast_to(np.arange(part.start + 1, part.stop + 1, dtype=np.uint64), (len(some), len(part))).copy()
                for i in range(rows):
                    band *= np.uint64(0x9E3779B97F4A7C15)
                    band ^= band >> np.uint64(29)
                    band += parts[:, :, i]
                yield pa.RecordBatch.from_arrays([pa.array(band.view(np.int64).ravel()), pa.array(np.repeat(some, len(part)))], ["band", name])

    return parallel(values).mapInArrow(run, f"band bigint, {name} bigint")
