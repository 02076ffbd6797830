"""Checks before a run and before an export: demo backends, and secrets in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Capabilities that a demo backend must not serve, words that mark a secret, and keys that only look like one.
CRITICAL = ("image.replacement.v1", "object.detection.v1", "object.segmentation.v1", "quality.semantic_match.v1")
WORDS = ("key", "token", "secret", "password", "credential", "authorization")
HARMLESS = ("candidate_key", "cache_key", "lineage_key", "key", "keys", "max_tokens", "idempotency_key")
REFERENCES = ("env:", "file:", "<redacted>")


def demo_backends(bindings: dict[str, dict], allow_demo: bool = False) -> list[str]:
    """Critical capabilities that are bound to a backend marked ``demo_only``; empty if that was allowed."""
    return [] if allow_demo else [f"{c} is served by demo backend {b['id']}" for c, b in sorted(bindings.items()) if c in CRITICAL and b.get("demo_only")]


def resolve(needs: list[str], providers: list[dict], explicit: dict[str, str] | None = None) -> tuple[dict[str, dict], list[str]]:
    """Bind each capability: explicitly, else by its only provider. Returns bindings and problems."""
    bound, problems = {}, []
    for need in needs:
        able = [p for p in providers if need in p["capabilities"]]
        wanted = (explicit or {}).get(need)
        if wanted:
            able = [p for p in able if p["id"] == wanted]
        if len(able) == 1:
            bound[need] = able[0]
        else:
            problems.append(f"{need}: no provider" if not able else f"{need}: several providers ({', '.join(p['id'] for p in able)})")
    return bound, problems


def _secret_name(name: str) -> bool:
    low = name.lower()
    return low not in HARMLESS and not low.endswith("_ref") and any(w in low for w in WORDS)


def secret_places(document: object, place: str = "$") -> list[str]:
    """Places of a document whose name marks a secret and whose value is neither empty nor a reference to one."""
    if isinstance(document, dict):
        out = []
        for k, v in document.items():
            here = f"{place}.{k}"
            plain = isinstance(v, str | int | float) and not isinstance(v, bool) and not str(v).startswith(REFERENCES) and v != ""
            out += [here] if _secret_name(str(k)) and plain else secret_places(v, here)
        return out
    if isinstance(document, list | tuple):
        return [p for i, v in enumerate(document) for p in secret_places(v, f"{place}[{i}]")]
    return []


def secret_columns(rows: DataFrame, column: str) -> DataFrame:
    """``name, n`` of secret entries in a map column."""
    named = rows.select(F.explode(column).alias("name", "value")).filter(F.col("value").isNotNull() & (F.col("value") != ""))
    low = F.lower("name")
    marked = ~low.isin(*HARMLESS) & ~low.endswith("_ref") & F.exists(F.array(*map(F.lit, WORDS)), lambda w: low.contains(w))
    reference = F.exists(F.array(*map(F.lit, REFERENCES)), lambda r: F.col("value").startswith(r))
    return named.filter(marked & ~reference).groupBy("name").agg(F.count("*").alias("n"))
