"""The stage plan: what runs for a sample, an object and a candidate, its cost, and its document form."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

# Declared unit estimates (seconds, cost) of the built-in backends. Planning only, never a measurement.
UNIT_ESTIMATES = {
    "builtin_detector": (0.02, 0.0), "builtin_segmenter": (0.03, 0.0), "builtin_scene": (0.02, 0.0), "builtin_planner": (0.01, 0.0),
    "builtin_replacement": (0.05, 0.0), "builtin_metrics": (0.05, 0.0), "builtin_refiner": (0.02, 0.0), "builtin_hash": (0.01, 0.0),
}

# The operators of each level, with the levels' ports in order.
SAMPLE_STAGES = ("ingest.image", "detect.objects", "select.targets")
OBJECT_STAGES = ("segment.target", "scene.analyse", "plan.replacement")
CANDIDATE_STAGES = ("generate.replacement", "refine.candidate", "verify.redetect", "evaluate.candidate", "annotate.rebuild", "export.sample")


@dataclass(frozen=True)
class Stage:
    """One operator over a relation: a row per sample, object or candidate. An absent object is an absent row, so nothing is reserved for it."""

    operator: str
    level: str
    after: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class StagePlan:
    max_per_sample: int = 1
    candidates_per_object: int = 1
    video: bool = False
    config: dict = field(default_factory=dict)

    @property
    def nodes_per_sample(self) -> int:
        """Upper bound of the rows all stages make for one sample."""
        return len(SAMPLE_STAGES) + self.video + self.max_per_sample * (len(OBJECT_STAGES) + len(CANDIDATE_STAGES) * self.candidates_per_object)

    @property
    def stages(self) -> list[Stage]:
        out: list[Stage] = []
        for level, names in (("sample", SAMPLE_STAGES), ("object", OBJECT_STAGES), ("candidate", CANDIDATE_STAGES)):
            for name in names:
                out.append(Stage(name, level, (out[-1].operator,) if out else (), self.config.get(name, {})))
        if self.video:
            out.append(Stage("video.plan_variants", "sample", ("ingest.image",), self.config.get("video.plan_variants", {})))
        return out

    def estimate(self, samples: int, backends: dict[str, str], units: dict[str, tuple[float, float]] = UNIT_ESTIMATES) -> dict[str, dict[str, float]]:
        """Rows, seconds and cost of each stage for a number of samples."""
        rows = {"sample": samples, "object": samples * self.max_per_sample, "candidate": samples * self.max_per_sample * self.candidates_per_object}
        out = {}
        for stage in self.stages:
            seconds, cost = units.get(backends.get(stage.operator, ""), (0.0, 0.0))
            n = rows[stage.level]
            out[stage.operator] = {"rows": n, "seconds": round(n * seconds, 6), "cost": round(n * cost, 6)}
        return out


def document(plan: StagePlan) -> dict:
    """The plan as nodes and edges with a digest over both."""
    nodes = [{"id": s.operator, "level": s.level, "config": s.config} for s in plan.stages]
    edges = [{"from": a, "to": s.operator} for s in plan.stages for a in s.after]
    body = {"version": 1, "max_per_sample": plan.max_per_sample, "candidates_per_object": plan.candidates_per_object, "nodes": nodes, "edges": edges}
    return body | {"digest": digest(body)}


def digest(body: dict) -> str:
    plain = {k: v for k, v in body.items() if k != "digest"}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class DocumentError(ValueError):
    """A workflow document that cannot be read or edited."""


def validate(doc: dict) -> list[str]:
    """Errors of a document: repeated or unknown ids, unknown operators, cycles."""
    known = {*SAMPLE_STAGES, *OBJECT_STAGES, *CANDIDATE_STAGES, "video.plan_variants", "video.submit", "video.status", "video.cancel"}
    ids = [n["id"] for n in doc.get("nodes", [])]
    errors = [f"node {i} is repeated" for i in sorted({i for i in ids if ids.count(i) > 1})]
    errors += [f"operator {i} is unknown" for i in ids if i not in known]
    errors += [f"edge {e['from']} -> {e['to']} names an unknown node" for e in doc.get("edges", []) if e["from"] not in ids or e["to"] not in ids]
    waiting = {i: {e["from"] for e in doc.get("edges", []) if e["to"] == i and e["from"] in ids} for i in ids}
    while ready := [i for i, needs in waiting.items() if not needs]:
        for i in ready:
            del waiting[i]
        for needs in waiting.values():
            needs.difference_update(ready)
    return errors + ([f"cycle through {', '.join(sorted(waiting))}"] if waiting else [])


def edit(doc: dict, expected: str, operations: list[dict]) -> dict:
    """Apply edits to the document that has the ``expected`` digest (compare and swap); contracts and ids stay checked.

    Operations: ``set_config`` (node, config), ``add_node`` (node), ``remove_node`` (id), ``add_edge`` and ``remove_edge`` (edge).
    """
    if digest(doc) != expected:
        raise DocumentError("the document changed since it was read")
    nodes, edges = [dict(n) for n in doc["nodes"]], [dict(e) for e in doc["edges"]]
    for op in operations:
        kind = op["op"]
        if kind == "set_config":
            found = [n for n in nodes if n["id"] == op["node"]]
            if not found:
                raise DocumentError(f"no node {op['node']}")
            found[0]["config"] = dict(op["config"])
        elif kind == "add_node":
            nodes.append(dict(op["node"]))
        elif kind == "remove_node":
            nodes = [n for n in nodes if n["id"] != op["id"]]
            edges = [e for e in edges if op["id"] not in (e["from"], e["to"])]
        elif kind == "add_edge":
            edges.append(dict(op["edge"]))
        elif kind == "remove_edge":
            edges = [e for e in edges if e != op["edge"]]
        else:
            raise DocumentError(f"unknown edit {kind}")
    out = {**doc, "nodes": nodes, "edges": edges}
    if errors := validate(out):
        raise DocumentError("; ".join(errors))
    return out | {"digest": digest(out)}
