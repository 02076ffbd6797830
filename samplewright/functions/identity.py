"""Content-derived identities: a prefix and the head of the SHA-256 of a canonical JSON text.

Canonical JSON has sorted keys and no white space. It is put together by hand, because ``to_json``
keeps the order of fields and prints large numbers in scientific form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters that a JSON string cannot hold as they are.
_ESCAPED = '["\\\\\\x00-\\x1f]'
#: Texts of the multiples of 0.05 from 0 to 1 as Python prints their products: 0.7000000000000001 for the fourteenth.
_TWENTIETHS = [repr(k * 0.05) for k in range(21)]


def text(value: Column) -> Column:
    """A JSON string; ``to_json`` is asked only for one with a quote, a backslash or a control character."""
    plain = F.concat(F.lit('"'), value, F.lit('"'))
    return F.when(value.rlike(_ESCAPED), F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', "")).otherwise(plain)


def number(value: Column) -> Column:
    """A whole or fractional number as Python prints it: 3.0, 0.25; -0.0 as 0.0. Whole numbers are not sent through the printing of fractions."""
    whole = F.when(F.abs(value) < 1e15, value).try_cast("bigint")
    return F.when(value == whole, F.concat(whole.cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


def score_text(score: Column) -> Column:
    """A score rounded to a multiple of 0.05, as Python prints it."""
    step = F.rint(score / 0.05).try_cast("int")
    return F.when(step.between(0, 20), F.get(F.array(*map(F.lit, _TWENTIETHS)), step)).otherwise(number(quantise(score, 0.05)))


def record(fields: dict[str, Column]) -> Column:
    """An object of already encoded values; null values are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def identifier(prefix: str, canonical: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical, 256), 1, length))


def quantise(value: Column, quantum: float) -> Column:
    """To the nearest multiple, halves to even."""
    return F.rint(value / quantum) * quantum


def sample_id(root_digest: Column, path: Column) -> Column:
    """Of a dataset sample: its content root and its path with forward slashes and no leading dots or slashes."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[./]+", "")
    return identifier("s_", record({"root": text(root_digest), "path": text(clean)}))


def object_id(asset: Column, frame: Column, class_name: Column, box: dict[str, Column], score: Column) -> Column:
    """Of an object in a frame; box and score are quantised so that jitter keeps the identity. ``asset`` is a digest, which needs no escapes.

    The record is put together in one piece: with a test for null around each part, the generated code is too long for the JVM to compile.
    """
    even = lambda v: F.concat((F.rint(v / 2.0).try_cast("bigint") * 2).cast("string"), F.lit(".0"))
    edges = F.concat_ws(",", *[even(box[e]) for e in ("x_min", "y_min", "x_max", "y_max")])
    whole = F.concat(F.lit('{"asset":"'), asset, F.lit('","box":['), edges, F.lit('],"class":'), text(class_name), F.lit(',"frame":'), frame.cast("string"), F.lit(',"score":'), score_text(score), F.lit("}"))
    return identifier("o_", whole, 12)


def candidate_id(sample: Column, target: Column, key: Column) -> Column:
    return identifier("c_", record({"sample": text(sample), "object": text(target), "key": text(key)}))


def node_id(operator: Column, lineage: Column, ordinal: Column) -> Column:
    return identifier("n_", record({"operator": text(operator), "lineage": text(lineage), "ordinal": ordinal.cast("string")}))


def job_id(recipe_hash: Column, seed: Column, marker: Column) -> Column:
    return identifier("j_", record({"recipe": text(recipe_hash), "seed": seed.cast("string"), "marker": text(marker)}))


def cache_key(**parts: Column) -> Column:
    """Of a node's result: every input, configuration, implementation and seed that can change it."""
    return F.sha2(record({k: text(v.cast("string")) for k, v in parts.items()}), 256)


def lineage_key(sample: Column, target: Column | None = None, candidate: Column | None = None) -> Column:
    parts = [F.concat(F.lit("sample:"), sample)]
    if target is not None:
        parts.append(F.concat(F.lit("object:"), target))
    if candidate is not None:
        parts.append(F.concat(F.lit("candidate:"), candidate))
    return F.concat_ws("/", *parts)
