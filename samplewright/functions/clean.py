"""Column expressions that read dirty digests, hashes, splits, categories and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: ASCII, Unicode separators, control characters, zero-width marks.
_SPACE = r"[\s\p{Z}\p{Cc}\p{Cf}]"


def bare(text: Column) -> Column:
    """Lower case without the white space around it; null stays null."""
    return F.lower(F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", ""))


def digest(text: Column) -> Column:
    """16 to 64 lower-case hexadecimal digits without a ``sha256:`` prefix; anything else is null."""
    plain = F.regexp_replace(bare(text), rf"^sha256:{_SPACE}*", "")
    return F.when(plain.rlike("^[0-9a-f]{16,64}$"), plain)


def fingerprint(text: Column) -> Column:
    """A 64-bit perceptual hash as BIGINT (two's complement); null unless 1 to 16 hexadecimal digits."""
    plain = F.regexp_replace(bare(text), "^0x", "")
    full = F.lpad(F.when(plain.rlike("^[0-9a-f]{1,16}$"), plain), 16, "0")
    high, low = (F.conv(F.substring(full, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def split_name(text: Column) -> Column:
    """``train``, ``validation`` or ``test``; null for every other split."""
    plain = bare(text)
    return (
        F.when(plain.isin("train", "training"), "train")
        .when(plain.isin("val", "valid", "validation"), "validation")
        .when(plain.isin("test", "testing"), "test")
    )


def category(text: Column) -> Column:
    """Lower case, blanks and underscores read as hyphens."""
    return F.regexp_replace(bare(text), r"[\s\p{Z}_]", "-")


def score(value: Column) -> Column:
    """The score if it lies in [0, 1]; null and NaN are no score. ``-0.0`` counts as 0."""
    return F.when((value >= 0) & (value <= 1) & ~F.isnan(value), value + F.lit(0.0))
