"""The whole card detection, an image at a time.

The single steps are operators over pixel rows (raster.py).  In a row, each of
them would deal all pixels anew; here the pixels of an image meet once, as
arrays with their places, and one pass makes all steps, so a table of images is
shuffled once, and a table that holds images as arrays, or pixels dealt by image
before, not at all.  A step works on one image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import BLOCK, DARK, EDGE_SHARE, SOBEL_THRESHOLD, TOLERANCE

FOUND = "image_id long, status string, bottom_edge int, left_edge int, is_foil boolean, start_y int, band_height int, used_enhanced boolean"
PLACED = {"y": "int", "x": "int", "r": "double", "g": "double", "b": "double"}
NONE = dict.fromkeys(["bottom_edge", "left_edge", "is_foil", "start_y", "band_height", "used_enhanced"])


def image_arrays(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, width, height, y, x, r, g, b): a row per image, with the places of its pixels and their channels; empty arrays without pixels.

    Pixels above or right of every image's lower left quarter, which nothing looks at, are not moved.
    """
    top, right = (images.select(f(F.floor(F.coalesce(c, F.lit(0)) / 2))).scalar() for f, c in ((F.min, "height"), (F.max, "width")))
    near = pixels.filter((F.col("y") >= top) & (F.col("x") < right))
    rows = near.groupBy("image_id").agg(F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) for c, t in PLACED.items()])).alias("p"))
    arrays = [F.coalesce(f"p.{c}", F.array().cast(f"array<{t}>")).alias(c) for c, t in PLACED.items()]
    return images.select("image_id", "width", "height").join(rows, "image_id", "left").select("image_id", "width", "height", *arrays)


def luma(rgb: np.ndarray) -> np.ndarray:
    return 0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2]


def dark_lines(gray: np.ndarray, axis: int) -> np.ndarray:
    """Lines of which more than EDGE_SHARE is dark."""
    return np.flatnonzero((gray < DARK).mean(axis=axis) > EDGE_SHARE) if gray.size else np.zeros(0, int)


def foil(rgb: np.ndarray) -> bool:
    gray, mean = luma(rgb), (rgb[0] + rgb[1] + rgb[2]) / 3
    spread = np.abs(rgb - mean).sum(axis=0).mean()
    bright, dark, middle = (gray > 180).mean(), (gray < 75).mean(), ((gray <= 180) & (gray >= 75)).mean()
    return int(spread > 15) + int(middle > 0.4) + int(dark < 0.3 and bright < 0.3) >= 2


def peaks(value: np.ndarray, margin: float, least: float) -> np.ndarray:
    """Places above least that exceed both neighbours by more than margin."""
    inner = value[1:-1]
    return np.flatnonzero((inner > least) & (inner > value[:-2] + margin) & (inner > value[2:] + margin)) + 1


def gradient_share(gray: np.ndarray) -> np.ndarray:
    """Share of strong gradients in each row but the first and last."""
    d = gray[:, 2:] - gray[:, :-2]
    s = gray[:, :-2] + 2 * gray[:, 1:-1] + gray[:, 2:]
    gx, gy = d[:-2] + 2 * d[1:-1] + d[2:], s[2:] - s[:-2]
    return (np.sqrt(gx * gx + gy * gy) > SOBEL_THRESHOLD).mean(axis=1)


def _around(v: np.ndarray) -> np.ndarray:
    """Sums over the up to nine neighbours of each place."""
    wide = np.pad(v, 1)
    rows = wide[:, :-2] + wide[:, 1:-1] + wide[:, 2:]
    return rows[:-2] + rows[1:-1] + rows[2:]


def pattern_rows(gray: np.ndarray) -> list[int]:
    """First rows of blocks that look like text."""
    h, w = gray.shape
    n = _around(np.ones_like(gray))
    mean = _around(gray) / n
    variance = np.maximum(0.0, _around(gray * gray) / n - mean * mean)
    out = []
    for top in range(h - BLOCK, -1, -BLOCK):
        likely = []
        for left in range(0, w - BLOCK, BLOCK):
            block = (slice(top, top + BLOCK), slice(left, left + BLOCK))
            bright = int((gray[block] > 128).sum())
            few, many = sorted((bright, BLOCK * BLOCK - bright))
            spread = variance[block].mean()
            likely.append(0.5 * (0.2 < few / many < 0.8) + 0.5 * (200 < spread < 2000))
        if likely and np.mean(likely) > 0.3:
            out.append(top)
    return out


def text_band(gray: np.ndarray) -> tuple[int, int, bool]:
    """First row and height of the text band, and whether profiles agreed on it."""
    h, w = gray.shape
    best = None
    near = gray[:, : int(np.floor(w * 0.8))]
    if near.size:
        edges = peaks(gradient_share(gray), 0, 0.1) + 1 if h > 4 and w > 2 else np.zeros(0, int)
        patterns = np.array(pattern_rows(gray), int)
        for y in peaks(near.mean(axis=1), 10, 30).tolist():
            score = 1 + sum(bool(((p != 0) & (np.abs(p - y) < TOLERANCE)).any()) for p in (edges, patterns))
            best = max(best, (score, -y)) if best else (score, -y)
    top = -best[1] if best else 0
    end = min(top + min(60, int(np.floor(h * 0.08))), h)
    low = int(np.floor(h * 0.15))
    return (top, end - top, True) if top > 0 and end > 0 else (h - low, low, False)


def placed(y: np.ndarray, x: np.ndarray, channels: list[np.ndarray], height: int, width: int) -> np.ndarray:
    """The lower left quarter (3, height, width) of an image's pixels, all of which have to be there once, or none; then it is not a number."""
    top, w = height // 2, width // 2
    near = (y >= top) & (y < 2 * top) & (x >= 0) & (x < w)
    at = (y[near].astype(np.int64) - top) * w + x[near]
    times = np.bincount(at, minlength=top * w)
    if (times > 1).any():
        raise ValueError(f"{(times > 1).sum()} pixels more than once in the lower left quarter")
    if 0 < len(at) < top * w:
        raise ValueError(f"{len(at)} of {top * w} pixels in the lower left quarter")
    rgb = np.full((3, top * w), np.nan)
    rgb[:, at] = [c[near] for c in channels]
    return rgb.reshape(3, top, w)


def cropped(channels: list[np.ndarray | None], height: int, width: int) -> np.ndarray:
    """The lower left quarter (3, height, width) of channels that hold an image row by row."""
    rgb = np.stack(channels) if all(c is not None for c in channels) else np.zeros((3, 0))
    if rgb.shape[1] != height * width:
        raise ValueError(f"{rgb.shape[1]} of {height * width} pixels")
    top = height // 2
    return rgb.reshape(3, height, width)[:, top : 2 * top, : width // 2]


def detect_quarter(card: np.ndarray) -> dict:
    """All steps for the lower left quarter (3, height, width) of one image."""
    w = card.shape[2]
    bottom = dark_lines(luma(card)[:, max(0, w - max(3, int(np.floor(w * 0.15)))) :], 1)
    if not len(bottom):
        return NONE | {"status": "no bottom edge"}
    card = card[:, : bottom[-1] + 1]
    h = card.shape[1]
    left = dark_lines(luma(card)[max(0, h - max(3, int(np.floor(h * 0.1)))) :], 0)
    found = NONE | {"bottom_edge": int(bottom[-1])}
    if not len(left):
        return found | {"status": "no left edge"}
    card = card[:, :, left[0] :]
    start, size, enhanced = text_band(luma(card))
    return found | {"left_edge": int(left[0]), "is_foil": foil(card), "start_y": start, "band_height": size, "used_enhanced": enhanced, "status": "found" if size > 0 else "empty band"}


def _detector(batches):
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            image, width, height = (batch.column(i)[k].as_py() for i in range(3))
            size = (height or 0, width or 0)
            y, x, *channels = (None if (v := batch.column(i)[k].values) is None else np.asarray(v) for i in range(3, 8))
            try:
                card = cropped(channels, *size) if y is None else placed(y, x, channels, *size)
            except ValueError as e:
                raise ValueError(f"image {image}: {e}") from e
            rows.append({"image_id": image} | detect_quarter(card))
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)


def detect(arrays: DataFrame) -> DataFrame:
    """The whole detection: a row per image (image_id, width, height, r, g, b, and y, x unless the channels are row by row); coordinates are those of each step's raster, as its crop left it.

    An image without pixels in its lower left quarter has no bottom edge.
    """
    columns = [(F.col(c) if c in arrays.columns else F.lit(None)).cast(f"array<{t}>").alias(c) for c, t in PLACED.items()]
    return arrays.select(F.col("image_id").cast("long"), "width", "height", *columns).mapInArrow(_detector, FOUND)
