"""Box, polygon and affine geometry as column expressions.

A box is four columns ``x_min, y_min, x_max, y_max`` under a prefix, or a struct of that form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x_min", "y_min", "x_max", "y_max")


def box(prefix: str = "") -> dict[str, Column]:
    return {e: F.col(f"{prefix}{e}") for e in EDGES}


def width(b: dict[str, Column]) -> Column:
    return F.greatest(b["x_max"] - b["x_min"], F.lit(0.0))


def height(b: dict[str, Column]) -> Column:
    return F.greatest(b["y_max"] - b["y_min"], F.lit(0.0))


def area(b: dict[str, Column]) -> Column:
    return width(b) * height(b)


def aspect(b: dict[str, Column]) -> Column:
    """Width over height, 0 for a degenerate box."""
    return F.when(height(b) > 0, F.try_divide(width(b), height(b))).otherwise(0.0)


def centroid(b: dict[str, Column]) -> tuple[Column, Column]:
    return (b["x_min"] + b["x_max"]) / 2, (b["y_min"] + b["y_max"]) / 2


def clip(b: dict[str, Column], w: Column, h: Column) -> dict[str, Column]:
    bound = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    return {"x_min": bound(b["x_min"], w), "y_min": bound(b["y_min"], h), "x_max": bound(b["x_max"], w), "y_max": bound(b["y_max"], h)}


def expand(b: dict[str, Column], by: Column | float) -> dict[str, Column]:
    return {"x_min": b["x_min"] - by, "y_min": b["y_min"] - by, "x_max": b["x_max"] + by, "y_max": b["y_max"] + by}


def scale(b: dict[str, Column], sx: Column | float, sy: Column | float) -> dict[str, Column]:
    return {"x_min": b["x_min"] * sx, "y_min": b["y_min"] * sy, "x_max": b["x_max"] * sx, "y_max": b["y_max"] * sy}


def normalise(b: dict[str, Column], w: Column, h: Column) -> dict[str, Column]:
    return {e: v / (w if e[0] == "x" else h) for e, v in b.items()}


def contains(b: dict[str, Column], x: Column, y: Column) -> Column:
    """The maximal edges belong to the box."""
    return x.between(b["x_min"], b["x_max"]) & y.between(b["y_min"], b["y_max"])


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return side("x_min", "x_max") * side("y_min", "y_max")


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union, 0 where the union is empty."""
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, F.try_divide(shared, union)).otherwise(0.0)


def overlap_on_smaller(a: dict[str, Column], b: dict[str, Column]) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, F.try_divide(intersection(a, b), smaller)).otherwise(0.0)


def polygon_area(ring: Column) -> Column:
    """Area of an outer ring, an array of structs ``x, y`` (shoelace)."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, shifted, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(ring) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda t, v: t + v)) / 2).otherwise(0.0)


def affine(b: dict[str, Column], m: dict[str, Column]) -> dict[str, Column]:
    """Bounding box of the four corners under ``x' = a x + c y + tx``, ``y' = b x + d y + ty``."""
    corners = [(b[x], b[y]) for x in ("x_min", "x_max") for y in ("y_min", "y_max")]
    xs = [m["a"] * x + m["c"] * y + m["tx"] for x, y in corners]
    ys = [m["b"] * x + m["d"] * y + m["ty"] for x, y in corners]
    return {"x_min": F.least(*xs), "y_min": F.least(*ys), "x_max": F.greatest(*xs), "y_max": F.greatest(*ys)}


def place(b: dict[str, Column], p: dict[str, Column]) -> dict[str, Column]:
    """Into an output window ``x, y, w, h``."""
    return {e: p[e[0]] + v * p["w" if e[0] == "x" else "h"] for e, v in b.items()}


def bucket(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """Name of the first bucket whose upper edge exceeds the value; null stays null."""
    out = F.when(value.isNull(), None)
    for edge, name in edges:
        out = out.when(value < edge, name)
    return out.otherwise(last)


# Bucket edges of object size, image coverage and aspect.
SIZE = [(32.0 * 32, "small"), (96.0 * 96, "medium"), (224.0 * 224, "large")]
COVERAGE = [(0.01, "tiny"), (0.05, "small"), (0.20, "medium")]


def size_bucket(pixels: Column) -> Column:
    return bucket(pixels, SIZE, "huge")


def scale_class(coverage: Column) -> Column:
    return bucket(coverage, COVERAGE, "large")


def aspect_bucket(ratio: Column) -> Column:
    return F.when(ratio <= 0, "unknown").when(ratio < 0.5, "tall").when(ratio < 0.9, "portrait").when(ratio <= 1.1, "square").when(ratio <= 2.0, "landscape").when(ratio > 2.0, "wide")
