"""Model and service calls as batch functions, with a ledger for those that must not be repeated.

A backend is ``(pandas.DataFrame) -> pandas.DataFrame`` with a declared output schema; :func:`call` runs it by ``mapInPandas``. Errors of a row are values in
``error_code``; they never end the job. The built-in backends are simple, deterministic and vectorised over images of one shape; generation is
marked as demo and refused for production by :mod:`samplewright.plans.guard`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions.seeds import derive
from samplewright.operators import raster
from samplewright.session import settle, ship


@dataclass(frozen=True)
class Backend:
    id: str
    capabilities: tuple[str, ...]
    run: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str
    demo_only: bool = False
    idempotent: bool = True
    retries: int = 0
    partitions: int | None = None
    per_second: float | None = None


class Registry:
    """Backends by id; a second registration under one id is refused unless it is the same."""

    def __init__(self) -> None:
        self.backends: dict[str, Backend] = {}

    def add(self, backend: Backend) -> Backend:
        if self.backends.get(backend.id, backend) != backend:
            raise ValueError(f"backend {backend.id} is registered with another definition")
        self.backends[backend.id] = backend
        return backend

    def providers(self) -> list[dict]:
        return [{"id": b.id, "capabilities": list(b.capabilities), "demo_only": b.demo_only} for b in self.backends.values()]


def call(rows: DataFrame, backend: Backend) -> DataFrame:
    """Rows through a backend. ``partitions`` bounds how many calls run at once; a rate is shared out among them."""
    ship(rows.sparkSession)
    if backend.partitions:
        rows = rows.repartition(backend.partitions)
    pause = backend.partitions / backend.per_second if backend.per_second and backend.partitions else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for batch in batches:
            if pause:
                time.sleep(max(0.0, last + pause * len(batch) - time.time()))
                last = time.time()
            for attempt in range(backend.retries + 1):
                try:
                    result = backend.run(batch)
                    break
                except Exception:  # noqa: BLE001
                    if attempt == backend.retries:
                        raise
            if len(result):
                yield result

    return rows.mapInPandas(run, backend.schema)


class Ledger:
    """Requests and results of calls that cost money or cannot be repeated.

    Requests are written before anything is sent; one that has a result, or whose outcome is unknown, is never sent again by itself.
    Run such a stage with speculation off and one attempt per task, unless the service takes the key as an idempotency token.
    """

    REQUEST, RESULT = "request_key string, payload string", "request_key string, status string, result string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")

    def results(self) -> DataFrame:
        """Settled results, and ``unknown`` for requests that were sent and have none."""
        known = self._read("results", self.RESULT)
        lost = self._read("sent", self.REQUEST).join(known, "request_key", "left_anti")
        return known.unionByName(lost.select("request_key", F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("result")))

    def submit(self, requests: DataFrame, send: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
        """Send what was never sent, then give the results of all ``requests``."""
        if self.spark.conf.get("spark.speculation", "false") == "true":
            raise RuntimeError("a ledger stage needs spark.speculation=false")
        new = settle(requests.select("request_key", "payload").dropDuplicates(["request_key"]).join(self._read("sent", self.REQUEST), "request_key", "left_anti"), "ledger")
        new.write.mode("append").parquet(f"{self.folder}/sent")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                try:
                    yield send(batch)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({"request_key": batch["request_key"], "status": "unknown", "result": str(e)})

        new.mapInPandas(run, self.RESULT).write.mode("append").parquet(f"{self.folder}/results")
        return requests.select("request_key").distinct().join(self.results(), "request_key")


class VideoTasks:
    """Asynchronous provider tasks on a ledger: submit once, poll, cancel. Nothing waits and nothing is sent again."""

    FINAL = ("succeeded", "failed", "cancelled")

    def __init__(self, ledger: Ledger, send, status, cancel) -> None:
        self.ledger, self.send, self.poll, self.stop = ledger, send, status, cancel

    def submit(self, requests: DataFrame) -> DataFrame:
        return self.ledger.submit(requests, self.send)

    def _refresh(self, tasks: DataFrame, ask) -> DataFrame:
        done = tasks.filter(F.col("status").isin(*self.FINAL, "unknown"))
        open_ = tasks.filter(~F.col("status").isin(*self.FINAL, "unknown"))
        return done.unionByName(open_.mapInPandas(lambda batches: (ask(b) for b in batches), Ledger.RESULT))

    def status(self, tasks: DataFrame) -> DataFrame:
        return self._refresh(tasks, self.poll)

    def cancel(self, tasks: DataFrame) -> DataFrame:
        return self._refresh(tasks, self.stop)


# ---- built-in backends ----------------------------------------------------------------------------------------


def stack(rows: pd.DataFrame, column: str, h: int, w: int, channels: int = 3) -> np.ndarray:
    """Images by channel, row, column in [0, 1] from packed bytes."""
    data = np.frombuffer(b"".join(rows[column]), np.uint8).reshape(len(rows), channels, h, w)
    return data / 255.0


def pack(images: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.round(np.clip(images, 0, 1) * 255).astype(np.uint8)]


def masks(rows: pd.DataFrame, column: str, h: int, w: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column]), np.uint8).reshape(len(rows), h, w) > 0


def pack_masks(m: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in m.astype(np.uint8)]


def _difference(images: np.ndarray) -> np.ndarray:
    """Distance of every pixel to the median colour of the image's border."""
    edge = np.concatenate([images[..., 0, :], images[..., -1, :], images[..., :, 0], images[..., :, -1]], -1)
    return np.abs(images - np.median(edge, -1)[..., None, None]).mean(1)


def _largest(mask: np.ndarray) -> np.ndarray:
    """The largest 4-connected part; of equal ones the first."""
    if not mask.any():
        return mask
    labels = raster.labels(mask)
    names, sizes = np.unique(labels[mask], return_counts=True)
    return labels == names[sizes.argmax()]


def _each_shape(kernel):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        parts = [kernel(rows.reset_index(drop=True), int(h), int(w)) for (h, w), rows in batch.groupby(["height", "width"])]
        return pd.concat(parts) if parts else pd.DataFrame()

    return run


#: A part of fewer pixels is no object.
LEAST_AREA = 4
# Fixed values of the built-in detector: luminance weights, thresholds of luminance and colour, share of the image that a part must have, least side of an
# image, and the score's base and its parts for contrast (full at 0.35) and size (full at a tenth of the image).
LUMINANCE, LIGHT, SPREAD, COLOUR, LEAST_SHARE, LEAST_SIDE = (0.299, 0.587, 0.114), 0.16, 2.5, 0.14, 0.002, 8
SCORE_BASE, SCORE_CONTRAST, FULL_CONTRAST, SCORE_SIZE, FULL_SIZE = 0.45, 0.40, 0.35, 0.15, 0.10


def _border(images: np.ndarray) -> np.ndarray:
    """The two outermost rows and columns of each image, flat, on the last axis."""
    flat = lambda x: x.reshape(*x.shape[:-2], -1)
    return np.concatenate([flat(images[..., :2, :]), flat(images[..., -2:, :]), flat(images[..., :2]), flat(images[..., -2:])], -1)


def _salient(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference in luminance from the border, and where luminance or colour stand out from it, freed of single pixels."""
    light = np.tensordot(np.array(LUMINANCE), images, (0, 1))
    edge = _border(light)
    level = np.median(edge, -1)[:, None]
    noise = np.median(np.abs(edge - level), -1) + 1e-3
    away = np.abs(light - level[..., None])
    tint = np.sqrt(((images - np.median(_border(images), -1)[..., None, None]) ** 2).sum(1))
    found = (away > np.maximum(LIGHT, noise * SPREAD)[:, None, None]) | (tint > COLOUR)
    return away, raster.dilate(raster.erode(found))


def _saliency(rows: pd.DataFrame, h: int, w: int, classes: Sequence[str], least_score: float, most: int) -> pd.DataFrame:
    owner, rank, scores, parts = [], [], [], []
    if len(rows) and min(h, w) >= LEAST_SIDE:
        for i, (away, m) in enumerate(zip(*_salient(stack(rows, "pixels", h, w)), strict=True)):
            labels = raster.labels(m)
            names, part, areas = np.unique(labels[m], return_inverse=True, return_counts=True)
            contrast = np.bincount(part, away[m], len(names)) / np.maximum(areas, 1)
            score = raster.unit(SCORE_BASE + SCORE_CONTRAST * np.minimum(1, contrast / FULL_CONTRAST) + SCORE_SIZE * raster.unit(areas / (h * w * FULL_SIZE)))
            order = [k for k in np.lexsort((-areas, -score)) if areas[k] >= max(1, int(LEAST_SHARE * m.size))]
            for r, k in [(r, k) for r, k in enumerate(order) if score[k] >= least_score][:most]:
                owner.append(i)
                rank.append(r)
                scores.append(score[k])
                parts.append(labels == names[k])
    found = np.stack(parts) if parts else np.zeros((0, h, w), bool)
    s = raster.shape_of(found)
    named = rows[["sample_id"]].iloc[owner].reset_index(drop=True)
    # A label of the image's own wins; else the classes are dealt in turn, in order of the score.
    own = rows["class_name"].iloc[owner].tolist() if "class_name" in rows else [None] * len(owner)
    dealt = [o if isinstance(o, str) else classes[r % len(classes)] for o, r in zip(own, rank, strict=True)]
    return named.assign(class_name=dealt, score=np.round(np.array(scores, float), 6), **{e: s[e].astype(float) for e in ("x_min", "y_min", "x_max", "y_max")}, area=s["area"].astype("int64"), mask=pack_masks(found))


def redetect(images: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of each image the part that stands out whose box has the highest IoU with the box of ``wanted``; empty if none overlaps."""
    out = np.zeros_like(wanted)
    box = raster.shape_of(wanted)
    for i, m in enumerate(_salient(images)[1]):
        labels = raster.labels(m)
        ys, xs = np.nonzero(m)
        names, part, areas = np.unique(labels[m], return_inverse=True, return_counts=True)
        low = lambda v: (e := np.full(len(names), max(m.shape)), np.minimum.at(e, part, v))[0]  # noqa: B023, E731
        high = lambda v: (e := np.zeros(len(names), int), np.maximum.at(e, part, v + 1))[0]  # noqa: B023, E731
        x0, y0, x1, y1 = low(xs), low(ys), high(xs), high(ys)
        side = lambda a, b, lo, hi: np.maximum(np.minimum(b, box[hi][i]) - np.maximum(a, box[lo][i]), 0)  # noqa: B023, E731
        shared = side(x0, x1, "x_min", "x_max") * side(y0, y1, "y_min", "y_max")
        own = (box["x_max"][i] - box["x_min"][i]) * (box["y_max"][i] - box["y_min"][i])
        iou = np.where(areas >= LEAST_AREA, shared / np.maximum((x1 - x0) * (y1 - y0) + own - shared, 1), 0.0)
        if len(iou) and iou.max() > 0:
            out[i] = labels == names[iou.argmax()]
    return out


def detector(classes: Sequence[str] = ("object",), vocabulary: Sequence[str] | None = None, least_score: float = 0.0, most: int = 100) -> Backend:
    """Parts that stand out from an image's border, the best score first, at most ``most`` an image.

    It can name the classes of ``vocabulary`` only: what is asked for beyond it is not detected, and with nothing left there are no detections.
    """
    known = sorted(set(classes) & set(vocabulary) if vocabulary is not None else set(classes))

    def kernel(rows: pd.DataFrame, h: int, w: int) -> pd.DataFrame:
        return _saliency(rows if known else rows.iloc[:0], h, w, known, least_score, most)

    return Backend("builtin_detector", ("object.detection.v1", "object.segmentation.v1"), _each_shape(kernel), "sample_id string, class_name string, score double, x_min double, y_min double, x_max double, y_max double, area bigint, mask binary")


SALIENCY = detector()


def _segment(rows: pd.DataFrame, h: int, w: int) -> pd.DataFrame:
    """Within the box, grown by a tenth, the pixels that differ from the border; its outline simplified to a polygon."""
    delta = _difference(stack(rows, "pixels", h, w))
    ys, xs = np.indices((h, w))
    edge = {e: rows[e].to_numpy(float)[:, None, None] for e in ("x_min", "y_min", "x_max", "y_max")}
    gx, gy = (edge["x_max"] - edge["x_min"]) * 0.1, (edge["y_max"] - edge["y_min"]) * 0.1
    inside = (xs >= edge["x_min"] - gx) & (xs < edge["x_max"] + gx) & (ys >= edge["y_min"] - gy) & (ys < edge["y_max"] + gy)
    found = np.stack([_largest(m) for m in (delta > 0.12) & inside]) if len(rows) else inside
    area = found.sum((-2, -1))
    error = np.select([area < 4, area > 0.98 * h * w], ["MASK_EMPTY", "MASK_INVALID"], "")
    rings = [raster.simplify(raster.outline(m)).ravel().astype(float).tolist() for m in found]
    return pd.DataFrame({"sample_id": rows["sample_id"], "object_id": rows["object_id"], "area": area.astype("int64"), "mask": pack_masks(found), "polygon": rings, "error_code": [e or None for e in error]})


SEGMENTER = Backend("builtin_segmenter", ("object.segmentation.v1",), _each_shape(_segment), "sample_id string, object_id string, area bigint, mask binary, polygon array<double>, error_code string")


def _scene(rows: pd.DataFrame, h: int, w: int) -> pd.DataFrame:
    rgb, m = stack(rows, "pixels", h, w), masks(rows, "mask", h, w)
    light = np.tensordot(np.array([0.299, 0.587, 0.114]), rgb, (0, 1))
    outside = ~raster.dilate(m, 4)
    mean = raster._mean_where(light, outside)
    spread = np.sqrt(np.maximum(raster._mean_where((light - mean[:, None, None]) ** 2, outside), 0))
    smooth = raster.window_mean(light, 9)
    dy, dx = np.gradient(smooth, axis=(-2, -1))
    tone = np.select([spread < 0.05, spread < 0.15], ["flat", "smoothly graded"], "busy")
    bright = np.select([mean < 0.3, mean < 0.6], ["dark", "mid-tone"], "bright")
    return pd.DataFrame({"sample_id": rows["sample_id"], "object_id": rows["object_id"], "luminance": np.round(mean, 6), "contrast": np.round(spread, 6), "light_direction": np.round(np.degrees(np.arctan2(raster._mean_where(dy, outside), raster._mean_where(dx, outside))), 3), "coverage": np.round(m.mean((-2, -1)), 6), "background": [f"a {t} {b} background" for t, b in zip(tone, bright, strict=True)]})


SCENE = Backend("builtin_scene", ("scene.analysis.v1",), _each_shape(_scene), "sample_id string, object_id string, luminance double, contrast double, light_direction double, coverage double, background string")


def category_colour(category: str) -> np.ndarray:
    """The colour that stands for a category in generated samples."""
    return np.random.default_rng(derive(0, "colour", category)).uniform(0.15, 0.9, 3)


def _generate(rows: pd.DataFrame, h: int, w: int) -> pd.DataFrame:
    images, m = stack(rows, "pixels", h, w), masks(rows, "mask", h, w)
    out = images.copy()
    for i, (seed, category) in enumerate(zip(rows["seed"], rows["category"], strict=True)):
        noise = np.random.default_rng(int(seed)).normal(0, 0.02, images.shape[1:])
        out[i][:, m[i]] = (category_colour(category)[:, None, None] + noise)[:, m[i]]
    return rows.drop(columns="pixels").assign(source_pixels=rows["pixels"], pixels=pack(out))


def generator(schema: str) -> Backend:
    """Seeded colour fill of the mask, for tests and dry runs."""
    return Backend("builtin_replacement", ("image.replacement.v1",), _each_shape(_generate), schema + ", source_pixels binary, pixels binary", demo_only=True)


def feather(m: np.ndarray, radius: int) -> np.ndarray:
    """Soft weight of a mask: its mean over a window, and 1 in its inner part."""
    soft = raster.window_mean(m.astype(float), 2 * radius + 1) if radius else m.astype(float)
    return np.where(raster.erode(m, radius), 1.0, np.where(raster.dilate(m, radius), soft, 0.0))


def refine(source: np.ndarray, produced: np.ndarray, m: np.ndarray, radius: int = 1, strength: float = 0.5) -> np.ndarray:
    """Harmonise the produced object with its surroundings and blend it in; shift and gain are both scaled by ``strength``."""
    ring = raster.dilate(m, 4) & ~m
    mean = lambda x, where: np.stack([raster._mean_where(x[:, c], where) for c in range(x.shape[1])], 1)
    around, own = mean(source, ring), mean(produced, m)
    gain = 1 + strength * 0.1 * (around.mean(1) / np.maximum(own.mean(1), 1e-6) - 1)
    shift = strength * 0.1 * (around - own)
    toned = np.clip(produced * gain[:, None, None, None] + shift[..., None, None], 0, 1)
    weight = feather(m, radius)[:, None]
    return np.where(m[:, None] | (weight > 0), toned * weight + source * (1 - weight), source)


def semantic(images: np.ndarray, m: np.ndarray, categories: list[str]) -> np.ndarray:
    """How near the mean colour under the mask is to the category's."""
    own = np.stack([raster._mean_where(images[:, c], m) for c in range(images.shape[1])], 1)
    wanted = np.stack([category_colour(c) for c in categories]) if categories else own
    return raster.unit(1 - np.abs(own - wanted).mean(1) / 0.5)
