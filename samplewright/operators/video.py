"""Video variants, contrast pairs and the projection of labels onto a variant."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions import geometry as g
from samplewright.functions.seeds import derive_column


@dataclass(frozen=True)
class Operator:
    """One augmentation axis and the values its parameters may take."""

    name: str
    axis: str
    domains: dict[str, Sequence]
    kind: str = "render"
    label_class: str = "preserved"
    probability: float = 1.0

    def choices(self) -> list[str]:
        """Every parameter setting as canonical JSON."""
        keys = sorted(self.domains)
        return [_json({"op": self.name, "params": dict(zip(keys, values, strict=True))}) for values in product(*(self.domains[k] for k in keys))]


@dataclass(frozen=True)
class Spec:
    id: str
    seed: int = 0
    strategy: str = "paired"
    max_variants: int = 16
    max_active_ops: int | None = None
    operators: Sequence[Operator] = field(default_factory=tuple)


def _json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _finish(rows: DataFrame, spec: Spec) -> DataFrame:
    """Truncate, filter by active operations, and name by content."""
    rows = rows.filter(F.col("ordinal") < spec.max_variants)
    if spec.max_active_ops is not None:
        rows = rows.filter(F.size("fingerprint") <= spec.max_active_ops)
    ops = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("fingerprint")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(spec.id), F.lit(str(spec.seed)), ops), 256), 1, 16)
    return rows.withColumn("variant_id", F.concat(F.lit(f"{spec.id}__v_"), digest)).select("variant_id", "ordinal", "fingerprint")


def variants(spark: SparkSession, spec: Spec) -> DataFrame:
    """``variant_id, ordinal, fingerprint`` (axis -> operation) of a spec.

    The full factorial is a product of the operators' choices, decoded from a range of numbers: any part of it is made by any task, and
    truncation is a filter on the range. Paired is the identity and all one-axis siblings; random draws by derived seeds.
    """
    choices = [o.choices() for o in spec.operators]
    if spec.strategy == "paired":
        total = 1 + sum(map(len, choices))
        rows = spark.range(min(total, spec.max_variants)).withColumnRenamed("id", "ordinal")
        sibling, start = F.create_map().cast("map<string,string>"), 1
        for o, c in zip(spec.operators, choices, strict=True):
            at = F.col("ordinal") - start
            sibling = F.when(at.between(0, len(c) - 1), F.create_map(F.lit(o.axis), F.get(F.array(*map(F.lit, c)), at.cast("int")))).otherwise(sibling)
            start += len(c)
        return _finish(rows.withColumn("fingerprint", sibling), spec)
    if spec.strategy == "random":
        rows = spark.range(max(0, spec.max_variants)).withColumnRenamed("id", "ordinal")
        drawn = [(F.lit(o.axis), F.get(F.array(*map(F.lit, c)), F.pmod(derive_column(spec.seed, F.lit("variant"), F.col("ordinal"), F.lit(o.axis)), F.lit(len(c))).cast("int"))) for o, c in zip(spec.operators, choices, strict=True)]
        return _finish(rows.withColumn("fingerprint", F.create_map(*[x for pair in drawn for x in pair]) if drawn else F.create_map().cast("map<string,string>")), spec)
    total = 1
    for c in choices:
        total *= len(c)
    rows = spark.range(min(total, spec.max_variants)).withColumnRenamed("id", "ordinal")
    entries, below = [], total
    for o, c in zip(spec.operators, choices, strict=True):
        below //= len(c)
        pick = F.pmod(F.floor(F.col("ordinal") / below), F.lit(len(c))) + 1
        entries += [F.lit(o.axis), F.element_at(F.array(*map(F.lit, c)), pick.cast("int"))]
    return _finish(rows.withColumn("fingerprint", F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")), spec)


def contrast_pairs(rows: DataFrame) -> DataFrame:
    """``left_id, right_id, axis, relation`` of variants whose fingerprints differ in exactly one axis.

    Two such variants agree once that axis is left out, so every variant is keyed by its fingerprint without each
    axis in turn, and by the whole one for an axis it lacks; equal keys meet in an equi-join.
    """
    keyed = rows.withColumn("axis", F.explode(F.array_union(F.map_keys("fingerprint"), F.array(F.lit("")))))
    rest = lambda fp, axis: F.concat_ws("|", F.transform(F.array_sort(F.map_entries(F.map_filter(fp, lambda k, v: k != axis))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    keyed = keyed.withColumn("rest", rest(F.col("fingerprint"), F.col("axis"))).withColumn("value", F.try_element_at("fingerprint", F.col("axis")))
    both = keyed.filter("axis <> ''")
    left, right = (both.select("axis", "rest", F.col("variant_id").alias(f"{s}_id"), F.col("ordinal").alias(f"{s}_at"), F.col("value").alias(f"{s}_value"), F.size("fingerprint").alias(f"{s}_size")) for s in ("left", "right"))
    changed = left.join(right, ["axis", "rest"]).filter("left_at < right_at and left_value <> right_value")
    # A variant without the axis agrees as a whole with the rest of one that has it.
    lacking = keyed.filter("axis = ''").select(F.col("rest"), F.col("variant_id").alias("a_id"), F.col("ordinal").alias("a_at"), F.size("fingerprint").alias("a_size"))
    having = both.select("axis", "rest", F.col("variant_id").alias("b_id"), F.col("ordinal").alias("b_at"), F.size("fingerprint").alias("b_size"))
    added = lacking.join(having, "rest")
    early = F.col("a_at") < F.col("b_at")
    added = added.select("axis", F.when(early, F.col("a_id")).otherwise(F.col("b_id")).alias("left_id"), F.when(early, F.col("b_id")).otherwise(F.col("a_id")).alias("right_id"), F.least("a_size", "b_size").alias("smaller"))
    out = changed.select("axis", "left_id", "right_id", F.least("left_size", "right_size").alias("smaller")).unionByName(added)
    relation = F.when(F.col("smaller") == 0, "identity-invariance").otherwise(F.concat("axis", F.lit("-invariance")))
    return out.select("left_id", "right_id", "axis", relation.alias("relation"))


def project_box(b: dict[str, Column], geometry: dict[str, Column], placement: dict[str, Column]) -> dict[str, Column]:
    """A normalised box through an affine map and into the output window."""
    return g.place(g.affine(b, geometry), placement)


def project_span(t0: Column, t1: Column, scale: Column, offset: Column) -> tuple[Column, Column]:
    """A span on the source clock onto the variant clock; a negative scale turns it around."""
    a, b = t0 * scale + offset, t1 * scale + offset
    return F.least(a, b), F.greatest(a, b)


def project_words(words: DataFrame, scale: Column, offset: Column, duration: Column | None = None) -> DataFrame:
    """Rows with ``t0, t1`` moved and clipped to the output; words of no length drop out."""
    t0, t1 = project_span(F.col("t0"), F.col("t1"), scale, offset)
    t0, t1 = F.greatest(t0, F.lit(0.0)), t1 if duration is None else F.least(t1, duration)
    return words.withColumns({"t0": t0, "t1": t1}).filter(F.col("t1") - F.col("t0") > 1e-6)


def compose(first: dict[str, Column], second: dict[str, Column]) -> dict[str, Column]:
    """``first`` from source to intermediate, then ``second`` to the output.

    Keys ``a b c d tx ty`` (geometry), ``scale offset`` (time), ``semantics``, and ``x y w h`` (placement, the second's alone).
    """
    f, s = first, second
    out = {
        "a": s["a"] * f["a"] + s["c"] * f["b"], "b": s["b"] * f["a"] + s["d"] * f["b"],
        "c": s["a"] * f["c"] + s["c"] * f["d"], "d": s["b"] * f["c"] + s["d"] * f["d"],
        "tx": s["a"] * f["tx"] + s["c"] * f["ty"] + s["tx"], "ty": s["b"] * f["tx"] + s["d"] * f["ty"] + s["ty"],
        "scale": s["scale"] * f["scale"], "offset": s["scale"] * f["offset"] + s["offset"],
    }
    either = lambda v: (f["semantics"] == v) | (s["semantics"] == v)
    out["semantics"] = F.when(either("synthesized"), "synthesized").when(either("edited"), "edited").otherwise("preserved")
    return out | {k: s[k] for k in "xywh"}


def label_transform(op: str, params: dict) -> dict[str, object]:
    """Label maths of the local render operations: speed, trim, reframe, grade, mute."""
    base = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 1.0, "tx": 0.0, "ty": 0.0, "scale": 1.0, "offset": 0.0, "semantics": "preserved", "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0}
    if op == "speed":
        return base | {"scale": 1.0 / float(params["factor"])}
    if op == "trim":
        return base | {"offset": -float(params["start"])}
    if op == "reframe":
        source, wanted = float(params["source_aspect"]), float(params["aspect"])
        # Letterbox: the picture keeps its form inside the new frame.
        w, h = (1.0, wanted / source) if wanted < source else (source / wanted, 1.0)
        return base | {"x": (1 - w) / 2, "y": (1 - h) / 2, "w": w, "h": h}
    if op in ("grade", "mute"):
        return base | {"semantics": "edited" if op == "grade" else "preserved"}
    raise ValueError(f"unknown render operation {op!r}")
