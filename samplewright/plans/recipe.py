"""The declarative recipe: strict, immutable configuration, its checks, and what follows from it."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import types
import typing
from dataclasses import dataclass, field

from samplewright.operators.gates import METRICS, Gate, Policy
from samplewright.operators.lineage import protected_splits_allowed


class RecipeError(ValueError):
    """All problems of a document at once, each with its place."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Dataset:
    path: str
    annotations: str = "none"
    split_mode: str = "none"
    augment_splits: tuple[str, ...] = ("train",)
    allow_protected_splits: bool = False
    max_samples: int | None = None
    recursive: bool = True


@dataclass(frozen=True)
class Target:
    classes: tuple[str, ...] = ()
    strategy: str = "all"
    order_by: str = "score"
    min_score: float = 0.0
    min_area_px: float = 0.0
    max_per_sample: int = 1
    object_ids: tuple[str, ...] = ()


@dataclass(frozen=True)
class Replacement:
    values: tuple[str, ...] = ()
    mode: str = "strict"
    candidates_per_object: int = 1
    prompt: str = "a {value} in place of the {class}"
    strategy: str = "category"
    description: str = ""
    references: tuple[str, ...] = ()

    @property
    def choices(self) -> tuple[str, ...]:
        """What candidates are made of in turn: categories, the description, or the names of the reference pictures."""
        if self.strategy == "description":
            return (self.description.strip(),)
        if self.strategy == "reference":
            return tuple(r.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0] for r in self.references)
        return tuple(dict.fromkeys(v.strip() for v in self.values if v.strip()))


@dataclass(frozen=True)
class Preserve:
    """What a replacement must leave as it is, and how far its form may stray. ``ground`` is a fraction of the image height."""

    background: str = "strict"
    lighting: bool = True
    pose: bool = True
    scale: bool = True
    position: bool = True
    occlusion: bool = True
    centroid: float = 0.08
    area_min: float = 0.70
    area_max: float = 1.45
    aspect: float = 0.30
    ground: float = 0.05

    @property
    def limits(self) -> dict[str, float]:
        """The limits of the geometry outcome."""
        return {"centroid_shift_max": self.centroid, "area_ratio_min": self.area_min, "area_ratio_max": self.area_max, "aspect_ratio_delta_max": self.aspect, "ground_contact_max": self.ground}

    @property
    def request(self) -> str:
        """The end of a prompt that names what is to be kept."""
        kept = ["background"] * (self.background == "strict") + [n for n in ("lighting", "pose", "scale", "position", "occlusion") if getattr(self, n)]
        return f", keep {', '.join(kept)}" if kept else ""


@dataclass(frozen=True)
class Quality:
    minimum_overall: float = 0.90
    review_band: float = 0.03
    hard_gates: dict = field(default_factory=dict)
    warn_gates: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)
    maximum_artifact_score: float = 0.10
    minimum_target_presence: float = 0.60
    background_change_ceiling: float = 0.06
    allow_missing_metrics: bool = True


@dataclass(frozen=True)
class Duplicates:
    algorithm: str = "phash"
    threshold: int = 6


@dataclass(frozen=True)
class Export:
    format: str = "coco"
    path: str = "export"
    include_review: bool = False
    strict: bool = True


@dataclass(frozen=True)
class Recipe:
    name: str
    dataset: Dataset
    seed: int = 0
    target: Target = Target()
    replacement: Replacement = Replacement()
    preserve: Preserve = Preserve()
    quality: Quality = Quality()
    duplicates: Duplicates = Duplicates()
    export: Export = Export()
    allow_demo_backends: bool = False

    @property
    def hash(self) -> str:
        plain = json.dumps(dataclasses.asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(plain.encode()).hexdigest()

    def policy(self) -> Policy:
        """Declared gates, with the artifact ceiling and the presence floor as gates of their own where they are not named."""
        q = self.quality
        gates = [Gate(m, t) for m, t in q.hard_gates.items()] + [Gate(m, t, "warn") for m, t in q.warn_gates.items()]
        named = {g.metric for g in gates}
        if "artifact_free" not in named:
            gates.append(Gate("artifact_free", round(1 - q.maximum_artifact_score, 6), "warn"))
        if "target_presence" not in named:
            gates.append(Gate("target_presence", q.minimum_target_presence))
        return Policy(q.minimum_overall, q.review_band, q.allow_missing_metrics, tuple(gates), dict(q.weights))


# Allowed words of the closed fields.
CHOICES = {
    ("dataset", "annotations"): ("none", "coco", "yolo"),
    ("dataset", "split_mode"): ("none", "directory", "filename", "manifest"),
    ("target", "strategy"): ("all", "largest", "first", "explicit"),
    ("target", "order_by"): ("score", "area"),
    ("replacement", "mode"): ("strict", "creative"),
    ("replacement", "strategy"): ("category", "description", "reference"),
    ("preserve", "background"): ("strict", "balanced", "loose"),
    ("duplicates", "algorithm"): ("phash", "ahash", "dhash", "none"),
    ("export", "format"): ("coco", "yolo"),
}
UNIT = {("quality", f) for f in ("minimum_overall", "review_band", "maximum_artifact_score", "minimum_target_presence", "background_change_ceiling")} | {("target", "min_score")}
POSITIVE = {("target", "max_per_sample"), ("replacement", "candidates_per_object")}


def _build(kind: type, value: object, place: str, problems: list[str]) -> object:
    if not isinstance(value, dict):
        problems.append(f"{place}: expected a mapping")
        return None
    before = len(problems)
    hints = typing.get_type_hints(kind)
    known = {f.name: f for f in dataclasses.fields(kind)}
    problems += [f"{place}.{k}: unknown field".lstrip(".") for k in value if k not in known]
    out = {}
    for name, spec in known.items():
        where = f"{place}.{name}".lstrip(".")
        if name not in value:
            if spec.default is dataclasses.MISSING and spec.default_factory is dataclasses.MISSING:
                problems.append(f"{where}: required")
            continue
        v, hint = value[name], hints[name]
        if isinstance(hint, types.UnionType):
            if v is None:
                out[name] = None
                continue
            hint = next(a for a in typing.get_args(hint) if a is not type(None))
        if dataclasses.is_dataclass(hint):
            out[name] = _build(hint, v, where, problems)
        elif typing.get_origin(hint) is tuple:
            if isinstance(v, list | tuple) and all(isinstance(x, str) for x in v):
                out[name] = tuple(v)
            else:
                problems.append(f"{where}: expected a list of strings")
        elif hint is float and isinstance(v, int | float) and not isinstance(v, bool):
            out[name] = float(v)
        elif isinstance(v, hint) and not (hint is int and isinstance(v, bool)):
            out[name] = v
        else:
            problems.append(f"{where}: expected {hint.__name__}")
    section = place
    for name, v in out.items():
        if v is None:
            continue
        if (words := CHOICES.get((section, name))) and v not in words:
            problems.append(f"{section}.{name}: must be one of {', '.join(words)}")
        if (section, name) in UNIT and not 0 <= v <= 1:
            problems.append(f"{section}.{name}: must lie in [0, 1]")
        if (section, name) in POSITIVE and v < 1:
            problems.append(f"{section}.{name}: must be at least 1")
    return kind(**out) if len(problems) == before else None


def load(document: dict) -> Recipe:
    """A recipe from a parsed document; every problem is reported at once."""
    problems: list[str] = []
    recipe = _build(Recipe, document, "", problems)
    if isinstance(recipe, Recipe) and not problems:
        q = recipe.quality
        problems += [f"quality: unknown metric {m}" for g in (q.hard_gates, q.warn_gates, q.weights) for m in g if m not in METRICS]
        problems += [f"quality: gate of {m} must lie in [0, 1]" for g in (q.hard_gates, q.warn_gates) for m, t in g.items() if not isinstance(t, int | float) or not 0 <= t <= 1]
        problems += [f"quality: {m} cannot be a hard and a warning gate" for m in q.hard_gates if m in q.warn_gates]
        problems += protected_splits_allowed(["val" if s in ("validation", "valid") else s for s in recipe.dataset.augment_splits], recipe.dataset.allow_protected_splits, recipe.export.strict)
        if recipe.target.strategy == "explicit" and not recipe.target.object_ids:
            problems.append("target.object_ids: strategy explicit needs some")
        needs = {"description": "description", "reference": "references"}.get(recipe.replacement.strategy)
        if needs and not any(recipe.replacement.choices):
            problems.append(f"replacement.{needs}: strategy {recipe.replacement.strategy} needs it")
        p = recipe.preserve
        problems += [f"preserve.{n}: must be positive" for n in ("centroid", "area_min", "area_max", "ground") if getattr(p, n) <= 0]
        problems += ["preserve.area_max: must not be below area_min"] * (p.area_max < p.area_min)
        if not 0 <= recipe.seed < 2**63:
            problems.append("seed: must lie in [0, 2^63 - 1]")
    if problems:
        raise RecipeError(problems)
    return recipe


def load_file(path: str) -> Recipe:
    """From YAML or JSON (JSON is YAML)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return load(yaml.safe_load(f) or {})
