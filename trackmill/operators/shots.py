"""Shots from a ball's track and the rim: rising flights, their fall past the rim, and whether they went in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.values import logistic
from trackmill.operators.pieces import numbers, spread, whole, whole_groups


BALL_TO_RIM = 0.53  # fixed value: a ball is 24 cm wide, a rim 45 cm


def make_features(dx: Column, vx_in: Column, vx_out: Column, vy_in: Column, vy_out: Column, apex: Column, depth: Column, bounced: Column, under: Column, size: Column) -> Column:
    """The nine numbers of the make model, in its order; what isn't a number takes its default. Null without a crossing."""
    real = lambda v, default: F.when(v.isNull() | F.isnan(v.cast("double")) | (F.abs(v) == float("inf")), default).otherwise(v.cast("double"))
    zero = F.lit(0.0)
    into, down = real(vx_in, zero), real(vy_in, zero)
    bit = lambda v: F.coalesce(v, F.lit(False)).cast("double")
    kept = F.least(F.lit(2.0), F.abs(real(vx_out, zero)) / F.greatest(F.lit(2.0), F.abs(into)))
    return F.when(dx.isNotNull(), F.array(F.abs(real(dx, zero)), real(vy_out, down) - down, down, kept, real(apex, zero), real(depth, F.lit(3.0)), bit(bounced), bit(under), real(size, F.lit(1.0))))


def made_by_model(features: Column, model: dict) -> Column:
    """(made, confidence) by a fitted model (mean, std, w, b, threshold); null features are a miss of confidence 0.7."""
    p = logistic([features[k] for k in range(len(model["w"]))], model["mean"], model["std"], model["w"], model["b"])
    known = features.isNotNull()
    return F.struct(F.when(known, p >= float(model.get("threshold", 0.5))).otherwise(False).alias("made"), F.when(known, 2 * F.abs(p - 0.5)).otherwise(0.7).alias("confidence"))


def detect_shots(track: DataFrame, rims: DataFrame, fps: float = 30.0, model: dict | None = None) -> DataFrame:
    """(video, release, apex, cross, dx, made, confidence, features) of shots.

    track has (video, frame, x, y) and may have size, rims (video, rx, ry, rr) with a row a video. A flight rises for four
    frames and 150 px at least, from 2.5 rim radii below the rim to 10 px above it, and comes near the rim on its way down.
    A video's track lies in one task, sorted, where its runs, falls and what is round a crossing are ranges of rows; many videos
    are looked at at once. A track that is dealt by video over all shuffle partitions isn't shuffled again.
    features holds the make model's nine numbers, null for a shot that never came down through the rim's level. With a model
    (mean, std, w, b, threshold) it decides made and confidence instead of the rule. Rows without a place are left out, as
    are videos without a rim.
    """
    if "size" not in track.columns:
        track = track.withColumn("size", F.lit(None).cast("double"))
    track = track.where("frame is not null and x is not null and y is not null").select("video", "frame", "x", "y", "size")
    down, after = int(1.5 * fps), int(0.5 * fps)
    real = lambda c: F.col(c).cast("double").alias(c)
    track = track.select("video", "frame", real("x"), real("y"), real("size"), F.lit(0).alias("_kind"))
    rims = rims.where("video is not null and rx is not null and ry is not null and rr is not null").select("video", real("rx"), real("ry"), real("rr"), F.lit(1).alias("_kind"))
    n = int(track.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = track.where("video is not null").repartition(n, "video").unionByName(rims.repartition(n, "video"), allowMissingColumns=True)
    dealt = both.repartition(n, "video").sortWithinPartitions("video", "_kind", "frame")

    def run(batches):
        for t, video in whole_groups(batches, ["video"]):
            ball = whole(t, "_kind") == 0
            row, rim = np.flatnonzero(ball), np.full((3, int(video[-1]) + 1), np.nan)
            rim[:, video[~ball]] = [numbers(t, c)[~ball] for c in ("rx", "ry", "rr")]
            at, columns = _shots_of(video[row], whole(t, "frame")[row], *(numbers(t, c)[row] for c in ("x", "y", "size")), rim, down, after)
            out = t.select(["video"]).take(pa.array(row[at]))
            for c in columns.items():
                out = out.append_column(*c)
            yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    kind = track.schema["frame"].dataType
    found = dealt.mapInArrow(run, f"video {track.schema['video'].dataType.simpleString()}, release long, apex long, cross long, dx double, height double, rr double, deep boolean, under boolean, bounce boolean, vin double, vout double, fin double, fout double, depth double, size double")
    full, rr = found.withColumns({c: F.col(c).cast(kind) for c in ("release", "apex", "cross")}), F.col("rr")
    braked = F.coalesce((F.abs("vin") > 4) & (F.abs("vout") <= 0.5 * F.abs("vin")), F.lit(False))
    off = F.abs("dx") / rr
    made = F.coalesce(F.col("cross").isNotNull() & (off <= 0.85) & F.col("deep") & (F.col("under") | braked) & ~F.col("bounce"), F.lit(False))
    sure = F.when(F.col("cross").isNull(), 0.7).otherwise(F.least(F.lit(1.0), F.abs(off - 0.85) / 0.85 + 0.3))
    features = make_features(F.col("dx") / rr, F.col("vin"), F.col("vout"), F.col("fin"), F.col("fout"), F.col("height"), F.col("depth"), F.col("bounce"), F.col("under"), F.col("size"))
    out = full.select("video", "release", "apex", "cross", "dx", made.alias("made"), sure.alias("confidence"), features.alias("features"))
    if model is None:
        return out
    by_model = made_by_model(F.col("features"), model)
    return out.withColumn("_m", by_model).withColumn("made", F.col("_m.made")).withColumn("confidence", F.col("_m.confidence")).drop("_m")


def _shots_of(video: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, rim: np.ndarray, down: int, after: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(row of the release, columns) of the shots in tracks sorted by video (from 0 on) and frame; rim has rx, ry, rr by video."""
    n = len(video)
    base, wide = (int(frame.min()), int(frame.max() - frame.min()) + 1) if n else (0, 1)
    place = video * wide + (frame - base)
    row_of = lambda v, f, side="left": np.searchsorted(place, v * wide + np.clip(f - base, -1 if side == "right" else 0, wide - (side == "right")), side)
    goes_on = np.zeros(n, bool)
    goes_on[1:] = (video[1:] == video[:-1]) & (np.diff(frame) <= 4) & (y[:-1] - y[1:] > 0.5)
    begin = np.flatnonzero(~goes_on)
    end = np.append(begin[1:], n)[: len(begin)] - 1
    rx, ry, rr = rim[:, video[begin]]
    height = y[end] - ry
    good = (frame[end] - frame[begin] + 1 >= 4) & (y[begin] - y[end] >= 150) & (y[begin] - ry >= 2.5 * rr) & (-height >= 10)
    begin, end, rx, ry, rr, height = (c[good] for c in (begin, end, rx, ry, rr, height))

    i, k = spread(end, row_of(video[end], frame[end] + down - 1, "right"))
    aside, below = np.abs(x[k] - rx[i]), y[k] - ry[i]
    near = (aside <= 4 * rr[i]) & (np.abs(below) <= 3 * rr[i]) | (k == end[i]) & (aside <= 9 * rr[i])
    close = np.bincount(i[near], minlength=len(end)) > 0
    back = np.maximum(k - 1, 0)
    through = np.flatnonzero((k > end[i]) & (y[back] < ry[i]) & (below >= 0))
    which, first = np.unique(i[through], return_index=True)
    k = k[through[first]]
    cross, dx = np.full(len(end), -1), np.full(len(end), np.nan)
    cross[which] = k
    dx[which] = x[k - 1] + (ry[which] - y[k - 1]) / (y[k] - y[k - 1]) * (x[k] - x[k - 1]) - rx[which]
    until = frame[np.where(cross >= 0, cross, end)]
    kept, now, last = [], -1, 0
    for j, v, at, to in zip(np.flatnonzero(close).tolist(), *(c[close].tolist() for c in (video[begin], frame[begin], until))):
        if v != now or at > last:
            kept.append(j)
            now, last = v, to
    begin, end, rx, ry, rr, height, cross, dx = (c[kept] for c in (begin, end, rx, ry, rr, height, cross, dx))

    some, v, at = cross >= 0, video[begin], frame[cross]
    i, k = spread(np.where(some, row_of(v, at), 0), np.where(some, row_of(v, at + after - 1, "right"), 0))
    below = y[k] - ry[i]
    deep = below >= 2.5 * rr[i]
    any_of = lambda where: pa.array(np.bincount(i[where], minlength=len(begin)) > 0, mask=~some)
    depth = np.full(len(begin), np.nan)
    np.fmax.at(depth, i, below / rr[i])

    def speed(value: np.ndarray, a: int, z: int) -> pa.Array:
        low, high = row_of(v, at + a), row_of(v, at + z, "right") - 1
        known = some & (high > low)
        low, high = np.where(known, low, 0), np.where(known, high, 0)
        return pa.array((value[high] - value[low]) / np.where(known, frame[high] - frame[low], 1), mask=~known)

    real = lambda c: pa.array(c, from_pandas=True)
    return begin, {
        "release": pa.array(frame[begin]), "apex": pa.array(frame[end]), "cross": pa.array(at, mask=~some), "dx": real(dx), "height": real(height), "rr": real(rr),
        "deep": any_of(deep), "under": any_of(deep & (np.abs(x[k] - rx[i]) <= 1.6 * rr[i])), "bounce": any_of(-below >= 0.5 * rr[i]),
        "vin": speed(x, -6, 0), "vout": speed(x, 3, 12), "fin": speed(y, -6, 0), "fout": speed(y, 3, 12), "depth": real(depth), "size": real(np.where(some, size[cross] / (rr * (2 * BALL_TO_RIM)), np.nan)),
    }
