"""Pixel kernels and their batch functions.

An image is a row ``width, height, pixels`` (grey, row by row, or three channels one after another). Kernels work on stacks of images of one shape, so an Arrow batch of
equal images is measured in a few numpy calls; images of several shapes in one batch are grouped by shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- kernels: the last two axes are rows and columns ---------------------------------------------------------


def window_mean(images: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window with repeated edges, by an integral image."""
    edge = [(0, 0)] * (images.ndim - 2) + [(size // 2, size // 2)] * 2
    sums = np.pad(images.astype(np.float64), edge, mode="edge").cumsum(-1).cumsum(-2)
    sums = np.pad(sums, [(0, 0)] * (images.ndim - 2) + [(1, 0), (1, 0)])
    h, w = images.shape[-2:]
    lower, upper = slice(0, h), slice(size, size + h)
    left, right = slice(0, w), slice(size, size + w)
    return (sums[..., upper, right] - sums[..., lower, right] - sums[..., upper, left] + sums[..., lower, left]) / size**2


def _mean_where(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Mean over the marked pixels of each image; 0 where none is marked."""
    n = where.sum((-2, -1))
    return np.where(n > 0, (values * where).sum((-2, -1)) / np.maximum(n, 1), 0.0)


def unit(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0.0, 1.0)


def ssim(a: np.ndarray, b: np.ndarray, region: np.ndarray | None = None) -> np.ndarray:
    """Structural similarity with an 8 pixel window; the region counts only 4 pixels off the border, or all pixels if nothing of it is left."""
    mean = lambda x: window_mean(x, 8)
    ma, mb = mean(a), mean(b)
    va, vb, cov = mean(a * a) - ma * ma, mean(b * b) - mb * mb, mean(a * b) - ma * mb
    c1, c2 = 0.01**2, 0.03**2
    field = (2 * ma * mb + c1) * (2 * cov + c2) / np.maximum((ma * ma + mb * mb + c1) * (va + vb + c2), 1e-12)
    whole = field.mean((-2, -1))
    if region is None:
        return unit(whole)
    inner = np.zeros(region.shape[-2:], bool)
    inner[4 : inner.shape[0] - 4, 4 : inner.shape[1] - 4] = True
    valid = region & inner
    return unit(np.where(valid.any((-2, -1)), _mean_where(field, valid), whole))


def gradient(images: np.ndarray) -> np.ndarray:
    """Length of the central difference, 0 on the border in that direction."""
    dy, dx = np.zeros_like(images, dtype=np.float64), np.zeros_like(images, dtype=np.float64)
    dy[..., 1:-1, :] = (images[..., 2:, :] - images[..., :-2, :]) / 2
    dx[..., :, 1:-1] = (images[..., :, 2:] - images[..., :, :-2]) / 2
    return np.hypot(dx, dy)


def _spread(masks: np.ndarray, radius: int, grow: bool) -> np.ndarray:
    """Dilation or erosion by an L1 diamond: a cross applied ``radius`` times. The image border does not erode."""
    out = masks if grow else ~masks
    for _ in range(max(0, radius)):
        wide = out.copy()
        wide[..., 1:, :] |= out[..., :-1, :]
        wide[..., :-1, :] |= out[..., 1:, :]
        wide[..., 1:] |= out[..., :-1]
        wide[..., :-1] |= out[..., 1:]
        out = wide
    return out if grow else ~out


def dilate(masks: np.ndarray, radius: int = 1) -> np.ndarray:
    return _spread(masks, radius, True)


def erode(masks: np.ndarray, radius: int = 1) -> np.ndarray:
    return _spread(masks, radius, False)


def band(masks: np.ndarray, radius: int) -> np.ndarray:
    return dilate(masks, radius) & ~erode(masks, radius)


def labels(mask: np.ndarray) -> np.ndarray:
    """The number of the first pixel of its 4-connected part for each marked pixel, and the number of pixels elsewhere.

    Every pixel takes the smallest label around it until nothing changes.
    """
    h, w = mask.shape
    none = h * w
    out = np.where(mask, np.arange(none).reshape(h, w), none)
    while True:
        low = out.copy()
        low[1:] = np.minimum(low[1:], out[:-1])
        low[:-1] = np.minimum(low[:-1], out[1:])
        low[:, 1:] = np.minimum(low[:, 1:], out[:, :-1])
        low[:, :-1] = np.minimum(low[:, :-1], out[:, 1:])
        low = np.where(mask, low, none)
        roots = np.append(low.ravel(), none)
        low = np.where(mask, roots[low], none)  # jump to the label of the label
        if (low == out).all():
            return out
        out = low


def components(mask: np.ndarray) -> np.ndarray:
    """Areas of the 4-connected parts, largest first."""
    return np.sort(np.unique(labels(mask)[mask], return_counts=True)[1])[::-1]


def difference(a: np.ndarray, b: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Absolute difference a pixel; images with channels (one axis more than the masks) are compared channel by channel, then averaged."""
    delta = np.abs(a - b)
    return delta.mean(1) if delta.ndim > masks.ndim else delta


def background(source: np.ndarray, produced: np.ndarray, masks: np.ndarray, feather: int = 2, threshold: float = 0.10) -> dict[str, np.ndarray]:
    """What changed outside the mask and its seam; nothing outside counts as unchanged.

    Images are grey, or have their channels on the second axis: a change of colour that keeps the brightness is a change. SSIM alone looks at the grey image.
    """
    outside = ~dilate(masks, feather)
    some = outside.any((-2, -1))
    delta = difference(source, produced, masks)
    soft = difference(window_mean(source, 2), window_mean(produced, 2), masks)
    flat = lambda x: x.mean(1) if x.ndim > masks.ndim else x
    return {
        "ssim": np.where(some, ssim(flat(source), flat(produced), outside), 1.0),
        "changed_ratio": _mean_where(delta > threshold, outside),
        "mean_delta": _mean_where(delta, outside),
        "perceptual_delta": np.where(some, unit(1 - _mean_where(soft, outside) / 0.25), 1.0),
    }


def boundary(images: np.ndarray, masks: np.ndarray, radius: int = 3) -> dict[str, np.ndarray]:
    """How the gradient on the contour compares with that just outside of it; an empty mask has no interior (NaN)."""
    slope, outer = gradient(images), dilate(masks, radius) & ~masks
    on = _mean_where(slope, band(masks, radius))
    off = np.where(outer.any((-2, -1)), _mean_where(slope, outer), on)
    present = masks.any((-2, -1))
    return {
        "seam": np.where(present, unit(1 - np.abs(on / np.maximum(off, 1e-6) - 1) / 1.5), 0.0),
        "gradient_gap": np.where(present, unit(np.abs(on - off) / np.maximum(np.maximum(on, off), 1e-6)), 1.0),
        "interior_area": np.where(present, erode(masks, radius).sum((-2, -1)), np.nan),
    }


def artifacts(images: np.ndarray, masks: np.ndarray) -> dict[str, np.ndarray]:
    """Evidence of floating parts, hard edges, text-like texture and broken shape."""
    slope = gradient(images)
    present = masks.any((-2, -1))
    on, off = _mean_where(slope, band(masks, 2)), _mean_where(slope, dilate(masks, 4) & ~dilate(masks, 1))
    strong = _mean_where(gradient(window_mean(images, 2)) > 0.25, masks)
    ratio, floating = np.ones(len(masks)), np.zeros(len(masks))
    height = masks.shape[-2]
    inside = _mean_where(slope, masks)
    for i in np.flatnonzero(present):
        areas = components(masks[i])
        ratio[i] = areas[0] / areas.sum()
        bottom = int(np.flatnonzero(masks[i].any(1))[-1])
        if bottom + 3 < height and inside[i] > 1e-6:
            below = slope[i, bottom + 1 : bottom + 4][:, masks[i, bottom]].mean()
            floating[i] = np.clip(1 - below / inside[i] / 0.35, 0, 1)
    return {
        "component_ratio": ratio,
        "floating": floating,
        "edge_density": np.where(present, unit(np.maximum(0, on - off) / np.maximum(off, 1e-6) / 3), 0.0),
        "text_like": np.where(present, unit((strong - 0.08) / 0.25), 0.0),
    }


def shape_of(masks: np.ndarray) -> dict[str, np.ndarray]:
    """Area, centroid and bounding box; NaN and an empty box for an empty mask."""
    h, w = masks.shape[-2:]
    area = masks.sum((-2, -1))
    rows, columns = masks.any(-1), masks.any(-2)
    some = area > 0
    n = np.maximum(area, 1)
    return {
        "area": area,
        "cx": np.where(some, (masks.sum(-2) * np.arange(w)).sum(-1) / n, np.nan), "cy": np.where(some, (masks.sum(-1) * np.arange(h)).sum(-1) / n, np.nan),
        "x_min": np.where(some, columns.argmax(-1), 0), "y_min": np.where(some, rows.argmax(-1), 0),
        "x_max": np.where(some, w - columns[..., ::-1].argmax(-1), 0), "y_max": np.where(some, h - rows[..., ::-1].argmax(-1), 0),
    }


def movement(source: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Change of place, size, form and ground contact between two masks; an empty one gives (1, 0, 1, 1)."""
    a, b = shape_of(source), shape_of(target)
    some = (a["area"] > 0) & (b["area"] > 0)
    form = lambda s: (s["x_max"] - s["x_min"]) / np.maximum(s["y_max"] - s["y_min"], 1)
    h, w = source.shape[-2:]
    return {
        "centroid_shift": np.where(some, np.hypot(b["cx"] - a["cx"], b["cy"] - a["cy"]) / np.hypot(h, w), 1.0),
        "area_ratio": np.where(some, b["area"] / np.maximum(a["area"], 1), 0.0),
        "aspect_delta": np.where(some, np.abs(form(b) - form(a)), 1.0),
        "contact_shift": np.where(some, np.abs(b["y_max"] - a["y_max"]) / max(1, h), 1.0),
    }


def outline(mask: np.ndarray) -> np.ndarray:
    """Corner points of the outer ring of a mask's first part, in order around it, as ``x, y`` on the pixel grid.

    The ring is walked along the edges between inside and outside, always keeping the inside on the right.
    """
    h, w = mask.shape
    inside = np.pad(mask, 1)
    if not mask.any():
        return np.empty((0, 2), int)
    y0, x0 = np.argwhere(mask)[0]
    # Directions: right, down, left, up; the pixel to the right and to the left of each step, from the corner (x, y).
    steps = ((1, 0), (0, 1), (-1, 0), (0, -1))
    right = ((0, 0), (-1, 0), (-1, -1), (0, -1))
    left = ((0, -1), (0, 0), (-1, 0), (-1, -1))
    at = lambda x, y, d: inside[y + d[1] + 1, x + d[0] + 1]
    x, y, d = int(x0), int(y0), 0
    ring = []
    while True:
        ring.append((x, y))
        x, y = x + steps[d][0], y + steps[d][1]
        while at(x, y, right[d]) and not at(x, y, left[d]) and (x, y) != (int(x0), int(y0)):
            x, y = x + steps[d][0], y + steps[d][1]
        if (x, y) == (int(x0), int(y0)):
            return np.array(ring)
        d = (d + 1) % 4 if not at(x, y, right[d]) else (d + 3) % 4


def simplify(ring: np.ndarray, tolerance: float = 1.0) -> np.ndarray:
    """The points of a ring from which it strays by more than ``tolerance`` otherwise (Douglas-Peucker on both halves)."""
    if len(ring) < 4:
        return ring
    far = int(np.abs(ring - ring[0]).sum(1).argmax())
    closed = np.concatenate([ring, ring[:1]])
    keep = np.zeros(len(closed), bool)
    keep[[0, far, len(ring)]] = True
    todo = [(0, far), (far, len(ring))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q = closed[a].astype(float), closed[b].astype(float)
        v, rel = q - p, closed[a + 1 : b] - p
        length = np.hypot(*v)
        away = np.abs(v[0] * rel[:, 1] - v[1] * rel[:, 0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return closed[:-1][keep[:-1]]


def _nearest(images: np.ndarray, size: int) -> np.ndarray:
    h, w = images.shape[-2:]
    at = lambda n: np.clip((np.arange(size) + 0.5) * n / size, 0, n - 1).astype(int)
    return images[..., at(h), :][..., at(w)]


def _word(bits: np.ndarray) -> np.ndarray:
    """64 bits, the first one the highest, as signed 64-bit numbers."""
    return np.packbits(bits.reshape(len(bits), 64), axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()


def perceptual_hashes(images: np.ndarray) -> dict[str, np.ndarray]:
    """Average, difference and DCT hash of grey images. The difference hash compares a 9 x 9 grid and keeps its first 64 of 72 bits."""
    small = _nearest(images, 8)
    grid = _nearest(images, 9)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[:, None] + 1) * k / 64) / np.sqrt(32)
    basis[:, 0] /= np.sqrt(2)
    low = (basis.T @ _nearest(images, 32) @ basis)[:, :8, :8].copy()
    low[:, 0, 0] = 0
    return {
        "ahash": _word(small > small.mean((-2, -1), keepdims=True)),
        "dhash": _word((grid[..., 1:] > grid[..., :-1]).reshape(len(grid), -1)[:, :64]),
        "phash": _word(low > low.mean((-2, -1), keepdims=True)),
    }


# ---- batch functions -----------------------------------------------------------------------------------------


def colour(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Stack of images in [0, 1] with up to three channels on the second axis, from flat rows."""
    flat = np.asarray(pixels, dtype=np.float64).reshape(len(pixels), -1, height, width)[:, :3]
    return np.where(flat.max((-3, -2, -1), keepdims=True) > 1.5, flat / 255, flat)


def grey(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Stack of grey images in [0, 1] from flat rows of one or more channels."""
    return colour(pixels, height, width).mean(1)


def by_shape(kernel: Callable[[pd.DataFrame, int, int], dict[str, np.ndarray]], keep: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Run a kernel on the rows of each image shape of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (h, w), rows in batch.groupby(["height", "width"]):
                yield pd.DataFrame({**{c: rows[c].to_numpy() for c in keep}, **kernel(rows, int(h), int(w))})

    return run


def hashes(images: DataFrame) -> DataFrame:
    """``id, ahash, dhash, phash`` of rows ``id, width, height, pixels``."""
    kind = images.schema["id"].dataType.simpleString()
    kernel = lambda rows, h, w: perceptual_hashes(grey(rows["pixels"].tolist(), h, w))
    return images.select("id", "width", "height", "pixels").mapInPandas(by_shape(kernel, ["id"]), f"id {kind}, ahash bigint, dhash bigint, phash bigint")


def covered(mask: str, width: str, height: str, x_min: str, y_min: str, x_max: str, y_max: str) -> Column:
    """Whether every pixel of a box's whole-pixel window is in the mask; an empty window is not."""

    def run(m: pd.Series, w: pd.Series, h: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for bits, wide, high, *box in zip(m, w, h, a, b, c, d, strict=True):
            x0, y0, x1, y1 = (max(0, int(v)) for v in box)
            window = np.frombuffer(bits, np.uint8).reshape(high, wide)[y0:y1, x0:x1]
            out.append(bool(window.size and window.all()))
        return pd.Series(out)

    return F.pandas_udf(run, "boolean")(mask, width, height, x_min, y_min, x_max, y_max)


MEASURES = ("ssim", "changed_ratio", "mean_delta", "perceptual_delta", "seam", "gradient_gap", "interior_area", "component_ratio", "floating", "edge_density", "text_like", "centroid_shift", "area_ratio", "aspect_delta", "contact_shift", "mask_iou", "coverage")


def measure(pairs: DataFrame) -> DataFrame:
    """Every pixel measurement of produced images against their sources.

    Rows ``id, source, produced, width, height`` and, if given, ``source_mask, mask`` (flat booleans); without them a mask is where an image exceeds its mean.
    """
    kind = pairs.schema["id"].dataType.simpleString()
    masked = "mask" in pairs.columns

    def kernel(rows: pd.DataFrame, h: int, w: int) -> dict[str, np.ndarray]:
        before, after = (colour(rows[c].tolist(), h, w) for c in ("source", "produced"))
        a, b = before.mean(1), after.mean(1)
        if masked:
            ma, mb = (np.array(rows[c].tolist(), bool).reshape(-1, h, w) for c in ("source_mask", "mask"))
        else:
            ma, mb = (x > x.mean((-2, -1), keepdims=True) for x in (a, b))
        union = (ma | mb).sum((-2, -1))
        out = {**background(before, after, ma), **boundary(b, mb), **artifacts(b, mb), **movement(ma, mb), "mask_iou": np.where(union > 0, (ma & mb).sum((-2, -1)) / np.maximum(union, 1), 0.0), "coverage": mb.mean((-2, -1))}
        return {m: np.round(out[m], 6) for m in MEASURES}

    columns = ["id", "source", "produced", "width", "height", *(["source_mask", "mask"] if masked else [])]
    out = pairs.select(*columns).mapInPandas(by_shape(kernel, ["id"]), f"id {kind}, " + ", ".join(f"{m} double" for m in MEASURES))
    return out.withColumn("interior_area", F.when(~F.isnan("interior_area"), F.col("interior_area")))


def mask_geometry(images: DataFrame, width: int = 8) -> DataFrame:
    """Area, centroid and box of the pixels above the mean, by array functions alone."""
    mean = F.aggregate("pixels", F.lit(0.0), lambda t, v: t + v) / F.size("pixels")
    marked = images.withColumn("__m", mean)
    cells = F.filter(F.transform("pixels", lambda v, i: F.when(v > F.col("__m"), i)), lambda i: i.isNotNull())
    marked = marked.withColumn("__c", cells)
    xs, ys = F.transform("__c", lambda i: i % width), F.transform("__c", lambda i: F.floor(i / width).cast("int"))
    total = lambda v: F.aggregate(v, F.lit(0), lambda t, x: t + x)
    n = F.size("__c")
    return marked.select("id", n.cast("bigint").alias("area"), (total(xs) / n).alias("cx"), (total(ys) / n).alias("cy"), F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), (F.array_max(xs) + 1).alias("x_max"), (F.array_max(ys) + 1).alias("y_max")).filter("area > 0")


def packed_masks(images: DataFrame) -> DataFrame:
    """``mask``: the pixels above the mean, packed into words of 32 bits."""
    mean = F.aggregate("pixels", F.lit(0.0), lambda t, v: t + v) / F.size("pixels")
    bits = F.transform("pixels", lambda v: F.when(v > F.col("__m"), 1).otherwise(0).cast("bigint"))
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size("pixels") - 1) / 32).cast("int")), lambda k: F.aggregate(F.slice(bits, k * 32 + 1, 32), F.lit(0).cast("bigint"), lambda t, b: t * 2 + b))
    return images.withColumn("__m", mean).withColumn("mask", words).drop("__m")


def packed_iou(a: Column, b: Column) -> Column:
    """IoU of packed masks by bit counts, 0 for an empty union."""
    count = lambda op: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(op(x, y))), F.lit(0), lambda t, n: t + n)
    union = count(lambda x, y: x.bitwiseOR(y))
    return F.when(union > 0, F.try_divide(count(lambda x, y: x.bitwiseAND(y)), union)).otherwise(0.0)
