"""Colour: hue, saturation, value, luminance, and small descriptions of a picture's colours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of red, green and blue in the luminance.
LUMINANCE = (0.299, 0.587, 0.114)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * LUMINANCE[0] + g * LUMINANCE[1] + b * LUMINANCE[2]


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue in degrees, saturation and value of colours in [0, 1]; grey has hue 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = lambda x, y, at: (F.try_divide(x - y, span) + at) * 60
    hue = F.when(span == 0, 0.0).when(top == r, F.pmod(turn(g, b, 0), F.lit(360.0))).when(top == g, turn(b, r, 2)).otherwise(turn(r, g, 4))
    return {"hue": hue, "saturation": F.when(top == 0, 0.0).otherwise(F.try_divide(span, top)), "value": top}


def hue_distance(a: Column, b: Column) -> Column:
    """The shorter way around the circle, in degrees."""
    gap = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(gap, F.lit(360.0) - gap)


def histograms(images: np.ndarray, bins: int = 3) -> np.ndarray:
    """Share of pixels in each of ``bins`` equal steps of every channel; images by channel, row, column in [0, 1]."""
    step = np.minimum((images * bins).astype(int), bins - 1)
    return np.stack([(step == b).mean((-2, -1)) for b in range(bins)], -1).reshape(len(images), -1)


def grid_occupancy(masks: np.ndarray, cells: int = 4) -> np.ndarray:
    """Share of marked pixels in each cell of a grid over the picture."""
    h, w = masks.shape[-2:]
    ys, xs = np.arange(h) * cells // h, np.arange(w) * cells // w
    return np.stack([masks[:, ys == i][:, :, xs == j].mean((-2, -1)) for i in range(min(cells, h)) for j in range(min(cells, w))], -1)
