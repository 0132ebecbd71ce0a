"""Boxes, distances and projective maps as columns. Boxes are structs of x, y, w, h; y points down."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, w, h) -> Column:
    return F.struct(*(F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in zip((x, y, w, h), "xywh")))


def shared_area(a: Column, b: Column) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 for empty boxes."""
    both = shared_area(a, b)
    return F.coalesce(F.try_divide(both, a["w"] * a["h"] + b["w"] * b["h"] - both), F.lit(0.0))


def overlap_share(own: Column, other: Column) -> Column:
    """The part of the own area (1 at least) that the other box covers."""
    return shared_area(own, other) / F.greatest(own["w"] * own["h"], F.lit(1.0))


def foot_point(b: Column) -> Column:
    return F.struct((b["x"] + b["w"] / 2).alias("x"), (b["y"] + b["h"]).alias("y"))


def torso(b: Column) -> Column:
    """The torso's part of a person's box: 15 to 55 hundredths of its height."""
    return F.struct(b["x"].alias("x"), (b["y"] + 0.15 * b["h"]).alias("y"), b["w"].alias("w"), (0.4 * b["h"]).alias("h"))


def hand_distance(ball_x: Column, ball_y: Column, b: Column) -> Column:
    """How far a ball is from where a person's hands can be, in heights of the person; 0 within reach."""
    aside = F.greatest(F.lit(0.0), F.abs(ball_x - (b["x"] + b["w"] / 2)) - b["w"] / 2)
    below = F.greatest(F.lit(0.0), ball_y - (b["y"] + 0.45 * b["h"]))
    above = F.greatest(F.lit(0.0), (b["y"] - 0.4 * b["h"]) - ball_y)
    return F.hypot(aside, below + above) / b["h"]


def clipped_box(b: Column, left: Column, top: Column, width: int, height: int) -> Column:
    """A box within a crop as centre and size in shares of the crop, clipped to it."""
    x0, y0 = F.greatest(b["x"] - left, F.lit(0.0)), F.greatest(b["y"] - top, F.lit(0.0))
    x1, y1 = F.least(b["x"] + b["w"] - left, F.lit(float(width))), F.least(b["y"] + b["h"] - top, F.lit(float(height)))
    return F.struct(((x0 + x1) / 2 / width).alias("cx"), ((y0 + y1) / 2 / height).alias("cy"), ((x1 - x0) / width).alias("w"), ((y1 - y0) / height).alias("h"))


def crop_origin(centre: Column, size: int, limit: int, jitter: Column | None = None) -> Column:
    """Where a crop of this size begins so that it holds the centre and stays within the frame."""
    at = centre - size / 2 + (jitter if jitter is not None else F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.floor(at), F.lit(limit - size))).cast("int")


def solve_homography(source: list, target: list) -> np.ndarray:
    """The 3 x 3 map of four or more point pairs: direct linear transform on normalised points."""
    a, b = np.asarray(source, float), np.asarray(target, float)
    if len(a) != len(b) or len(a) < 4:
        raise ValueError("a homography takes four or more pairs of points")

    def normal(p):
        scale = np.sqrt(2) / max(np.linalg.norm(p - p.mean(0), axis=1).mean(), 1e-12)
        return np.array([[scale, 0, -scale * p[:, 0].mean()], [0, scale, -scale * p[:, 1].mean()], [0, 0, 1]])

    ta, tb = normal(a), normal(b)
    one = np.ones((len(a), 1))
    p, q = np.hstack([a, one]) @ ta.T, np.hstack([b, one]) @ tb.T
    zero = np.zeros_like(p)
    rows = np.vstack([np.hstack([p, zero, -q[:, :1] * p]), np.hstack([zero, p, -q[:, 1:2] * p])])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2]


def homography_column(source: Column, target: Column) -> Column:
    """(h, error) for each row's point pairs (arrays of [x, y]): the map's nine numbers and the mean distance by which it misses
    the target points; null where there are fewer than four pairs, or not as many on both sides."""

    @F.pandas_udf("h array<double>, error double")
    def solved(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(a, b):
            if p is None or q is None or len(p) != len(q) or len(p) < 4:
                rows.append((None, None))
                continue
            p, q = np.stack(p), np.stack(q)
            h = solve_homography(p, q)
            rows.append((h.ravel().tolist(), reprojection_error(h, p, q)))
        return pd.DataFrame(rows, columns=["h", "error"])

    return solved(source, target)


def project(h, x: Column, y: Column) -> Column:
    """A point mapped by a homography: nine numbers, or an array column of nine."""
    k = (lambda i: h[i]) if isinstance(h, Column) else (lambda i: F.lit(float(np.asarray(h).ravel()[i])))
    depth = k(6) * x + k(7) * y + k(8)
    return F.struct(F.try_divide(k(0) * x + k(1) * y + k(2), depth).alias("x"), F.try_divide(k(3) * x + k(4) * y + k(5), depth).alias("y"))


def reprojection_error(h: np.ndarray, source: list, target: list) -> float:
    p = np.hstack([np.asarray(source, float), np.ones((len(source), 1))]) @ np.asarray(h).reshape(3, 3).T
    return float(np.linalg.norm(p[:, :2] / p[:, 2:] - np.asarray(target, float), axis=1).mean())


def scaled_points(points: Column, factor: float) -> Column:
    return F.transform(points, lambda p: F.transform(p, lambda v: v * factor))


def rim_centre(left, right, front=None, back=None) -> tuple[float, float]:
    """The rim's centre from its edge points: x between the sides, y between front and back where they are known."""
    ys = [p[1] for p in (front, back) if p is not None] or [left[1], right[1]]
    return (left[0] + right[0]) / 2, sum(ys) / len(ys)


def cm_to_court(x: Column, y: Column, width_cm: float = 1505.0) -> Column:
    """Dataset centimetres with the origin in the right corner as court metres."""
    return F.struct(((width_cm / 2 - x) / 100).alias("x"), (y / 100).alias("y"))
