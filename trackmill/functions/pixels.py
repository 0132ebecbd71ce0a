"""Colours of decoded images as pandas functions: an image is a binary column of height x width x 3 bytes (blue, green, red)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bins and limits of a colour vector; hue runs to 180, saturation and brightness to 255.
HUES, SATURATIONS, LEAST_SATURATION, LEAST_VALUE, LEAST_PIXELS, HUE_REACH = 18, 4, 60, 50, 20, 12.0


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue (0 to 179), saturation and brightness (0 to 255) of ... x 3 bytes."""
    b, g, r = (bgr[..., k].astype(float) for k in range(3))
    top = np.maximum(np.maximum(b, g), r)
    spread = top - np.minimum(np.minimum(b, g), r)
    wide = np.where(spread == 0, 1, spread)
    hue = np.where(top == r, (g - b) / wide, np.where(top == g, 2 + (b - r) / wide, 4 + (r - g) / wide)) * 30
    hue = np.where(spread == 0, 0, np.where(hue < 0, hue + 180, hue))
    return np.stack([np.rint(hue) % 180, np.rint(255 * spread / np.where(top == 0, 1, top)), top], -1).astype(np.uint8)


def colour_vector(bgr: np.ndarray, court_hue: float | None = None) -> tuple[list[float] | None, float]:
    """(square roots of the shares of hue x saturation bins, share of coloured pixels); no vector from too few pixels.

    Pixels near the court's hue aren't counted.
    """
    if not bgr.size:
        return None, 0.0
    h, s, v = np.moveaxis(hsv(bgr), -1, 0)
    keep = (s >= LEAST_SATURATION) & (v >= LEAST_VALUE)
    if court_hue is not None:
        away = np.abs(h.astype(float) - court_hue)
        keep &= np.minimum(away, 180 - away) > HUE_REACH
    share = float(keep.mean())
    if keep.sum() < LEAST_PIXELS:
        return None, share
    bins, _, _ = np.histogram2d(h[keep], s[keep], [np.linspace(0, 180, HUES + 1), np.linspace(LEAST_SATURATION, 256, SATURATIONS + 1)])
    return np.sqrt(bins / bins.sum()).ravel().tolist(), share


def court_hue(bgr: np.ndarray) -> float | None:
    """The median hue of coloured ones of the floor's pixels (n x 3); null if under 30 % are coloured."""
    h, s, _ = np.moveaxis(hsv(bgr), -1, 0)
    coloured = h[s >= LEAST_SATURATION]
    return float(np.median(coloured)) if len(bgr) and len(coloured) >= 0.3 * len(bgr) else None


def area_means(image: np.ndarray, high: int, wide: int) -> np.ndarray:
    """The image at another size: each new pixel is the mean of the area that it covers, parts of pixels by their share.

    Sums up to each place, also between two pixels, come from running sums; an area's is a difference of two, first along
    the rows and then along the columns.
    """
    out = image.astype(float)
    for axis, size in ((0, high), (1, wide)):
        n = out.shape[axis]
        upto = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        edges = np.arange(size + 1) * (n / size)
        whole = np.minimum(edges.astype(int), n - 1)
        part = (edges - whole).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        out = np.diff(upto.take(whole, axis) + part * out.take(whole, axis), axis=axis) * (size / n)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def letterbox(bgr: np.ndarray, size: int = 128, fill: int = 114) -> np.ndarray:
    """The image scaled by areas to fit a square, in the middle of an even grey."""
    out = np.full((size, size, 3), fill, np.uint8)
    if bgr.size:
        scale = size / max(bgr.shape[:2])
        h, w = (max(1, round(n * scale)) for n in bgr.shape[:2])
        top, left = (size - h) // 2, (size - w) // 2
        out[top : top + h, left : left + w] = area_means(bgr, h, w)
    return out


def torso_image(bgr: np.ndarray, x: float, y: float, w: float, h: float, size: int = 128) -> np.ndarray | None:
    """The square picture of a person's torso (the band from 0.15 to 0.55 of the box's height); null under 8 pixels."""
    left, top, right, down = max(0, int(x)), max(0, int(y + 0.15 * h)), min(bgr.shape[1], int(x + w)), min(bgr.shape[0], int(y + 0.55 * h))
    return None if right - left < 8 or down - top < 8 else letterbox(bgr[top:down, left:right], size)


# Fixed values of the search for a flying ball: hues, least saturation and brightness of its colour, and least change of grey.
BALL_HUES, BALL_SATURATION, BALL_VALUE, GREY_CHANGE = (3, 20), 130, 80, 25
GREY = (1868, 9617, 4899)  # fixed values: weights of blue, green and red in grey, in parts of 2^14


def moving_pixels(bgr: np.ndarray, before: np.ndarray | None) -> int:
    """How many pixels have the ball's colour and another grey than in the frame before."""
    if before is None or before.shape != bgr.shape:
        return 0
    h, s, v = np.moveaxis(hsv(bgr), -1, 0)
    grey = lambda x: (x.astype(np.int32) @ np.array(GREY, np.int32) + (1 << 13)) >> 14
    coloured = (h >= BALL_HUES[0]) & (h <= BALL_HUES[1]) & (s >= BALL_SATURATION) & (v >= BALL_VALUE)
    return int((coloured & (np.abs(grey(bgr) - grey(before)) > GREY_CHANGE)).sum())


def moving_score(frames: DataFrame, step: int = 1, piece: int = 900) -> DataFrame:
    """(video, frame, score) of frames (video, frame, image, height, width): moving_pixels against the frame `step` before, 0
    if that is missing, null or of another size.

    A window hands each frame the one before it; so that a long video is many tasks, its frames are cut into pieces, and
    the last frame of a piece also stands at the head of the next one. Frames whose video or number is null are left out.
    """
    rows = frames.where(F.col("video").isNotNull() & F.col("frame").isNotNull()).withColumn("_piece", F.floor(F.col("frame") / piece))
    heads = rows.withColumns({"_piece": F.floor((F.col("frame") + step) / piece), "_head": F.lit(True)}).where(F.col("_piece") != F.floor(F.col("frame") / piece))
    both = rows.withColumn("_head", F.lit(False)).unionByName(heads)
    there = Window.partitionBy("video", "_piece").orderBy("frame").rangeBetween(-step, -step)
    old = both.withColumn("_old", F.last(F.struct("image", "height", "width")).over(there)).where(~F.col("_head"))
    pairs = old.withColumn("_before", F.when((F.col("_old.height") == F.col("height")) & (F.col("_old.width") == F.col("width")), F.col("_old.image")))

    @F.pandas_udf("long")
    def score(data: pd.Series, old: pd.Series, high: pd.Series, wide: pd.Series) -> pd.Series:
        image = lambda d, h, w: np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3)
        return pd.Series([0 if d is None or o is None else moving_pixels(image(d, h, w), image(o, h, w)) for d, o, h, w in zip(data, old, high, wide)], dtype="int64")

    return pairs.select("video", "frame", score("image", "_before", "height", "width").alias("score"))


def colour_column(image: str, height: str, width: str, hue: str | None = None):
    """A struct (vector, share) for each image of a frame; a null image has no vector and share 0."""

    @F.pandas_udf("vector array<double>, share double")
    def vectors(data: pd.Series, high: pd.Series, wide: pd.Series, away: pd.Series) -> pd.DataFrame:
        looks = [(None, 0.0) if d is None else colour_vector(np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3), None if pd.isna(a) else float(a)) for d, h, w, a in zip(data, high, wide, away)]
        return pd.DataFrame(looks, columns=["vector", "share"])

    return vectors(F.col(image), F.col(height), F.col(width), F.col(hue).cast("double") if hue else F.lit(None).cast("double"))


def court_hue_column(image: str):
    """court_hue of each image of floor pixels (bytes of blue, green, red); null for a null image."""

    @F.pandas_udf("double")
    def hues(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else court_hue(np.frombuffer(d, np.uint8).reshape(-1, 3)) for d in data], dtype="float64")

    return hues(F.col(image))


def letterbox_column(image: str, height: str, width: str, size: int):
    """letterbox of each image of a frame, as bytes; null for a null image."""

    @F.pandas_udf("binary")
    def boxed(data: pd.Series, high: pd.Series, wide: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else letterbox(np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3), size).tobytes() for d, h, w in zip(data, high, wide)], dtype=object)

    return boxed(F.col(image), F.col(height), F.col(width))
