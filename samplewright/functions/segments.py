"""Segment keys over fixed-length strings for bounded edit distance.

A 64-bit hash is a string of 64 binary digits. Strings of one length that are a bounded number of
edits apart differ by substitutions only (distances count differing bits), so a shared segment
starts at the same position in both. The string is cut into ``segments`` pieces; after ``tau``
substitutions at least ``segments - tau`` pieces are untouched, so the index stores every choice of
that many pieces by its positions, and a probe looks up the same choices. This loses no pair.

More pieces make longer keys and smaller buckets: 8 give 28 keys of 16 bits a string, 9 give 84 of
21, 10 give 210 of 25, 11 give 462 of 29. :func:`pieces_for` takes the fewest for which a bucket is expected to hold at
most BUCKET strings, so the pairs that a string meets are bounded by keys x BUCKET at every size.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.session import shuffled

BITS, TAU, SEGMENTS, MOST_SEGMENTS = 64, 6, 8, 12
#: Strings a bucket is expected to hold at most. A key costs about thirty times as much as a comparison, so with more than this the next, three times
#: as many keys pay for themselves.
BUCKET = 64
#: Bits of a key that say which pieces were chosen.
_CHOICE = 10


def _ends(segments: int) -> list[int]:
    return [BITS * i // segments for i in range(segments + 1)]


def _choices(segments: int, tau: int) -> list[tuple[int, ...]]:
    return list(combinations(range(segments), segments - tau))


def pieces_for(strings: int, tau: int = TAU) -> int:
    """The fewest pieces that keep buckets of ``strings`` strings at BUCKET or less."""
    return next((s for s in range(tau + 2, MOST_SEGMENTS) if strings <= BUCKET << BITS * (s - tau) // s), MOST_SEGMENTS)


def key_columns(column: str, segments: int = SEGMENTS, tau: int = TAU) -> list[Column]:
    """The keys of a hash in the order of their choices: the chosen pieces side by side, then the choice's number."""
    ends, out = _ends(segments), []
    for number, chosen in enumerate(_choices(segments, tau)):
        key, at = F.lit(number).cast("bigint"), _CHOICE
        for i in chosen:
            width = ends[i + 1] - ends[i]
            piece = F.shiftrightunsigned(F.col(column), ends[i]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            key, at = key.bitwiseOR(F.shiftleft(piece, at)), at + width
        out.append(key)
    return out


def index(values: DataFrame, column: str, segments: int = SEGMENTS, tau: int = TAU) -> DataFrame:
    """``values`` once for each ``key``."""
    return values.select("*", F.explode(F.array(*key_columns(column, segments, tau))).alias("key"))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def first_meeting(a: Column, b: Column, key: Column, segments: int = SEGMENTS, tau: int = TAU) -> Column:
    """Whether the key at hand is the first of the keys two strings share, so each pair comes out once without a distinct."""
    differ, ends = a.bitwiseXOR(b), _ends(segments)
    same = F.lit(0)
    for i in range(segments):
        mask = ((1 << ends[i + 1]) - 1) ^ ((1 << ends[i]) - 1)
        same = same.bitwiseOR(F.when(differ.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> 63 else mask)) == 0, 1 << i).otherwise(0))
    before = F.array(*[F.lit((1 << chosen[-1]) - 1) for chosen in _choices(segments, tau)])
    choice = key.bitwiseAND(F.lit((1 << _CHOICE) - 1).cast("bigint")).cast("int")
    return F.bit_count(same.bitwiseAND(F.get(before, choice))) == segments - tau - 1


def near_pairs(probe: DataFrame, stored: DataFrame, segments: int = SEGMENTS, tau: int = TAU) -> DataFrame:
    """Pairs ``a, b, distance`` of a probed and a stored hash with at most ``tau`` differing bits.

    Both sides are outputs of :func:`index` over distinct hashes in a column ``h``. AQE splits a bucket that many different hashes share.
    """
    a, b, distance = F.col("a"), F.col("b"), hamming(F.col("a"), F.col("b"))
    met = probe.select(F.col("h").alias("a"), "key").join(shuffled(stored.select(F.col("h").alias("b"), "key")), "key")
    return met.filter((distance <= tau) & first_meeting(a, b, F.col("key"), segments, tau)).select("a", "b", distance.alias("distance"))


def near_among(keys: DataFrame, segments: int = SEGMENTS, tau: int = TAU) -> DataFrame:
    """Pairs ``a, b, distance`` of two different hashes of one index, in both orders.

    Each bucket is compared with itself once, in one order, so both sides of the join are the same shuffle.
    """
    a, b, distance = F.col("a"), F.col("b"), hamming(F.col("a"), F.col("b"))
    met = keys.select(F.col("h").alias("a"), "key").join(shuffled(keys.select(F.col("h").alias("b"), "key")), "key")
    half = met.filter((a < b) & (distance <= tau) & first_meeting(a, b, F.col("key"), segments, tau)).select("a", "b", distance.alias("distance"))
    return half.select(F.inline(F.array(F.struct("a", "b", "distance"), F.struct(b.alias("a"), a.alias("b"), "distance"))))


def prefix(column: str, least: int = 16) -> Column:
    """The segment that equal digests share, however short they were cut: their first ``least`` digits."""
    return F.substring(column, 1, least)


def prefix_pairs(probe: DataFrame, stored: DataFrame) -> DataFrame:
    """``a`` and the columns of ``stored`` for every digest ``d`` of ``probe`` and ``b`` of ``stored`` of which one begins with the other."""
    left = probe.select(F.col("d").alias("a"), prefix("d").alias("segment"))
    a, b = F.col("a"), F.col("b")
    return left.join(shuffled(stored.withColumn("segment", prefix("b"))), "segment").filter(a.startswith(b) | b.startswith(a)).drop("segment")
