"""Image directories: discovery, header probes, ingest checks and pixels."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from PIL import Image
except ImportError:  # then only PNG is read
    Image = None

from samplewright.operators import lineage
from samplewright.session import settle

# Suffixes that are images, directories that hold no samples, and the ingest limits.
SUFFIXES = ("jpg", "jpeg", "png", "webp")
METADATA = ("annotations", "labels", "metadata", "__MACOSX")
MAX_PIXELS, MAX_SIDE = 64_000_000, 16_384
HEAD = 65_536
UNREAD = "only PNG files are read without Pillow"


def probe(data: bytes) -> dict[str, object]:
    """Kind and size from a file's head: PNG, JPEG, WebP (three forms) and MP4 (duration only). ``reason`` says why it failed."""
    out: dict[str, object] = {"kind": None, "width": None, "height": None, "duration_s": None, "reason": None}
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h = struct.unpack(">II", data[16:24])
            return out | {"kind": "png", "width": w, "height": h}
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                marker = data[at + 1]
                if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD9:
                    at += 1 if marker == 0xFF else 2
                    continue
                (length,) = struct.unpack(">H", data[at + 2 : at + 4])
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return out | {"kind": "jpeg", "width": w, "height": h}
                at += 2 + length
            return out | {"kind": "jpeg", "reason": "no frame header"}
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            form = data[12:16]
            if form == b"VP8X":
                w, h = 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            elif form == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                w, h = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            else:
                w, h = (v & 0x3FFF for v in struct.unpack("<HH", data[26:30]))
            return out | {"kind": "webp", "width": w, "height": h}
        if data[4:8] == b"ftyp":
            at = data.find(b"mvhd")
            if at < 0:
                return out | {"kind": "mp4", "reason": "no movie header"}
            wide = data[at + 4] == 1
            scale, length = struct.unpack(">IQ" if wide else ">II", data[at + (24 if wide else 16) :][: 12 if wide else 8])
            return out | {"kind": "mp4", "duration_s": length / scale if scale else None}
    except struct.error:
        return out | {"reason": "truncated header"}
    return out | {"reason": "unknown format"}


PARTS = ["kind", "width", "height", "duration_s", "reason"]
_PROBED = "kind string, width int, height int, duration_s double, reason string"


def _probe_all(heads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dict.fromkeys(PARTS) if h is None else probe(bytes(h)) for h in heads], columns=PARTS).astype({"kind": object, "reason": object})


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``relative_path, digest, size_bytes, kind, width, height, reason`` of every file that may be a sample.

    Hidden parts and metadata directories are passed over. Videos, unreadable headers and too large images stay in the result with a reason. Only
    the head of a file crosses to Python, but for JPEG files whose metadata reach beyond it: those are probed whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*(?=/)", "")
    files = files.withColumn("relative_path", F.substring(path, len(base) + 2, 1 << 20))
    parts = F.split("relative_path", "/")
    passed = F.exists(parts, lambda p: p.startswith(".") | p.isin(*METADATA))
    suffix = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    files = files.filter(~passed & suffix.isin(*SUFFIXES, "mp4"))
    find = F.pandas_udf(_probe_all, _PROBED)
    files = files.withColumn("p", find(F.substring("content", 1, HEAD)))
    beyond = (F.col("p.kind") == "jpeg") & F.col("p.reason").isNotNull() & (F.col("length") > HEAD)
    files = files.withColumn("whole", find(F.when(beyond, F.col("content"))))
    out = files.select("relative_path", F.sha2("content", 256).alias("digest"), F.col("length").alias("size_bytes"), F.when(beyond, F.col("whole")).otherwise(F.col("p")).alias("p")).select("relative_path", "digest", "size_bytes", "p.*")
    return out.withColumn("reason", refusal())


def with_split(found: DataFrame, mode: str, folder: str) -> DataFrame:
    """``split`` of each file by the recipe's mode; without one all are ``train``. A manifest is ``splits.json``, an object of paths and splits."""
    if mode == "manifest":
        listed = found.sparkSession.read.text(f"{folder}/splits.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("relative_path", "split"))
        return lineage.split_from_manifest(found, listed.withColumn("relative_path", F.replace("relative_path", F.lit("\\"), F.lit("/"))))
    path = F.col("relative_path")
    return found.withColumn("split", {"directory": lineage.split_from_directory, "filename": lineage.split_from_filename}.get(mode, lambda _: F.lit("train"))(path))


def refusal() -> F.Column:
    """Why a probed file is no sample, or null."""
    return (
        F.when(F.col("kind") == "mp4", F.lit("video is not supported"))
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when((F.col("width") < 1) | (F.col("height") < 1), F.lit("empty image"))
        .when((F.col("width") > MAX_SIDE) | (F.col("height") > MAX_SIDE) | (F.col("width").cast("bigint") * F.col("height") > MAX_PIXELS), F.lit("image too large"))
    )


def ingest(found: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples to work on, and the refused ones with ``error_code``; a file whose digest is not the expected one is refused."""
    rows = found if expected is None else found.join(expected.select("relative_path", F.col("digest").alias("__d")), "relative_path", "left")
    changed = F.lit(False) if expected is None else F.coalesce(F.col("__d") != F.col("digest"), F.lit(False))
    code = F.when(F.col("kind") == "mp4", "MEDIA_UNSUPPORTED").when(F.col("reason").isNotNull(), "MEDIA_UNREADABLE").when(changed, "SOURCE_CHANGED")
    marked = rows.withColumn("error_code", code).drop("__d")
    return marked.filter("error_code is null").drop("error_code"), marked.filter("error_code is not null")


def first_samples(found: DataFrame, most: int) -> DataFrame:
    return found.orderBy("relative_path").limit(most)


def readable(good: DataFrame, folder: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Images ``sample_id, width, height, pixels`` of three channels from ingested files, and the files that cannot be decoded with ``reason`` and ``error_code``.

    Grey becomes three equal channels. ``most`` counts decoded samples, so files that drop out do not use it up.
    """
    base = good.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    content = base.withColumn("digest", F.sha2("content", 256)).select("digest", "content").dropDuplicates(["digest"])
    decoded = settle(pixels(good.join(content, "digest").select("relative_path", "content")), "pixels")
    wrong = decoded.filter("error is not null").select("relative_path", "error")
    unread = F.col("reason").eqNullSafe(UNREAD)
    refused = good.drop("reason").join(wrong.withColumnRenamed("error", "reason"), "relative_path").withColumn("error_code", F.when(unread, "MEDIA_UNSUPPORTED").otherwise("MEDIA_UNREADABLE"))
    fine = decoded.filter("error is null")
    if most is not None:
        fine = fine.join(first_samples(fine.select("relative_path"), most), "relative_path", "left_semi")
    three = F.when(F.col("channels") == 1, F.concat("pixels", "pixels", "pixels")).otherwise(F.col("pixels"))
    return fine.select(F.col("relative_path").alias("sample_id"), "width", "height", three.alias("pixels")), refused


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the lines of a PNG (a filter kind, then the filtered bytes, ``step`` bytes a pixel).

    A byte depends on its left, upper and upper left neighbours, so all bytes of an antidiagonal are taken at once; lines of the kinds that need no such care go line by line.
    """
    kinds, raw = rows[:, 0], rows[:, 1:].reshape(len(rows), -1, step).astype(np.int32)
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown line filter")
    h, w = raw.shape[:2]
    out = np.zeros((h + 1, w + 1, step), np.int32)
    if not np.isin(kinds, (3, 4)).any():
        for y in range(h):
            line = raw[y].cumsum(0) if kinds[y] == 1 else raw[y] + out[y, 1:] if kinds[y] == 2 else raw[y]
            out[y + 1, 1:] = line & 255
        return out[1:, 1:].reshape(h, -1).astype(np.uint8)
    for d in range(w + h - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y][:, None]
        p = left + up - corner
        da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
        nearest = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, nearest], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].reshape(h, -1).astype(np.uint8)


# First column and row, and steps between columns and rows, of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(data: bytes) -> np.ndarray:
    """Height x width x channels in 8 bits of a PNG: grey, RGB or palette of any depth, with or without alpha (which is dropped) or interlace. Of 16 bits the higher 8 are kept."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, palette = 8, [], None
    while at + 8 <= len(data):
        length, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        if name == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + length
    if w * h > MAX_PIXELS:
        raise ValueError("too many pixels")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stream = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    image, begin = np.zeros((h, w, channels), np.uint8), 0
    for x0, y0, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        ws, hs = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if ws <= 0 or hs <= 0:
            continue
        line = -(-ws * channels * depth // 8)
        rows = stream[begin : begin + hs * (line + 1)].reshape(hs, line + 1)
        begin += rows.size
        flat = _unfiltered(rows, max(1, channels * depth // 8))
        if depth == 16:
            flat = flat.reshape(hs, -1, 2)[..., 0]
        elif depth < 8:
            bits = np.unpackbits(flat, axis=1).reshape(hs, -1, depth)
            flat = (bits * (1 << np.arange(depth)[::-1])).sum(-1)[:, : ws * channels].astype(np.uint8)
            flat = flat if colour == 3 else flat * (255 // ((1 << depth) - 1))
        image[y0::dy, x0::dx] = flat.reshape(hs, ws, channels)
    if colour == 3:
        image = palette[image[..., 0]]
    return image[..., : 1 if colour in (0, 4) else 3]


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels in 8 bits: PNG by :func:`decode_png`, JPEG and WebP by Pillow where it is installed."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if Image is None:
        raise ValueError(UNREAD)
    with Image.open(io.BytesIO(data)) as picture:
        if picture.width * picture.height > MAX_PIXELS:
            raise ValueError("too many pixels")
        return np.asarray(picture.convert("L" if picture.mode == "L" else "RGB")).reshape(picture.height, picture.width, -1)


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of a uint8 grey or RGB image."""
    image = np.ascontiguousarray(image if image.ndim == 3 else image[..., None], dtype=np.uint8)
    h, w, channels = image.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], 1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def pixels(files: DataFrame) -> DataFrame:
    """``relative_path, width, height, channels, pixels, error`` of rows ``relative_path, content``; what cannot be decoded is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["relative_path"], batch["content"], strict=True):
                try:
                    image = decode(bytes(content))
                    # Channels lie one after another, as the kernels read them.
                    out.append((path, image.shape[1], image.shape[0], image.shape[2], image.transpose(2, 0, 1).tobytes(), None))
                except (ValueError, KeyError, IndexError, zlib.error, struct.error, TypeError, UnboundLocalError, OSError) as e:
                    out.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["relative_path", "width", "height", "channels", "pixels", "error"]).astype({c: "Int32" for c in ("width", "height", "channels")})

    return files.select("relative_path", "content").mapInPandas(run, "relative_path string, width int, height int, channels int, pixels binary, error string")
