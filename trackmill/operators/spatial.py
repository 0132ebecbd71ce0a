"""Joins of boxes and points within a frame: always an equi-join on the frame, then a condition on its few rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.geometry import iou, overlap_share
from trackmill.operators.matching import in_window


def best_overlap(left: DataFrame, right: DataFrame, on: list[str], left_id: str, left_box: str, right_id: str, right_box: str, least: float = 0.5) -> DataFrame:
    """(on, left_id, right_id, iou): for each left box the right box with the largest IoU of at least `least`, else nulls."""
    pairs = left.select(*on, left_id, F.col(left_box).alias("_a")).join(right.select(*on, right_id, F.col(right_box).alias("_b")), on).withColumn("iou", iou(F.col("_a"), F.col("_b"))).where(F.col("iou") >= least)
    best = pairs.groupBy(*on, left_id).agg(F.max(F.struct("iou", right_id)).alias("_m")).select(*on, left_id, F.col(f"_m.{right_id}").alias(right_id), F.col("_m.iou").alias("iou"))
    return left.select(*on, left_id).join(best, [*on, left_id], "left")


def track_owners(tracks: DataFrame, persons: DataFrame, truth: DataFrame, true_id: str, by: list[str], before: int = 3, after: int = 12, least: float = 0.5) -> DataFrame:
    """(by, true_id): the true player whom a track overlaps most often near a frame, null without any.

    tracks (video, by, release, track) asks; persons (video, frame, track, box) and truth (video, frame, true_id, true_box) have
    frames counted alike. In each frame the best box of IoU `least` or more has a vote (of equal ones the largest id); of
    equal votes the one that came first wins. Boxes are compared in the frames asked for only.
    """
    seen = in_window(tracks.select("video", *by, "release", "track"), persons.select("video", "track", "frame", "box"), ["video", "track"], "release", "frame", before, after)
    boxes = seen.select("video", "frame", "track", "box").distinct()
    best = best_overlap(boxes, truth, ["video", "frame"], "track", "box", true_id, "true_box", least).where(F.col(true_id).isNotNull())
    votes = seen.select("video", *by, "frame", "track").join(best.select("video", "frame", "track", true_id), ["video", "frame", "track"])
    counts = votes.groupBy("video", *by, true_id).agg(F.count("*").alias("_n"), (-F.min("frame")).alias("_first"))
    most = counts.groupBy("video", *by).agg(F.max(F.struct("_n", "_first", true_id)).getField(true_id).alias(true_id))
    return tracks.select("video", *by).join(most, ["video", *by], "left")


def overlap_of_others(df: DataFrame, on: list[str], row_id: str, box: str) -> DataFrame:
    """For each box the largest share of its area that another box of the frame covers; 0 without others."""
    other = df.select(*on, F.col(row_id).alias("_id"), F.col(box).alias("_b"))
    pairs = df.select(*on, row_id, F.col(box).alias("_a")).join(other, on).where(F.col(row_id) != F.col("_id"))
    found = pairs.groupBy(*on, row_id).agg(F.max(overlap_share(F.col("_a"), F.col("_b"))).alias("overlap"))
    return df.select(*on, row_id).join(found, [*on, row_id], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def occlusion(df: DataFrame, on: list[str], row_id: str, box: str, grid: int = 16, others: str | None = None) -> DataFrame:
    """For each box the share of a grid of its points that lie in any other row's box (`others`, if it is another column).

    Another box covers a span of the grid's columns in a span of its rows. Each row is the bitwise or of the columns that reach
    it, an aggregate that is summed up before the shuffle; the grid is never exploded. Edges count as inside (within a
    thousand-millionth of a step).
    """
    if not 0 < grid < 63:
        raise ValueError("a row of the grid has to fit into a long: 1 to 62 points")
    other = df.select(*on, F.col(row_id).alias("_id"), F.col(others or box).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    touch = (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"]) & (a["y"] <= b["y"] + b["h"]) & (b["y"] <= a["y"] + a["h"])
    pairs = df.select(*on, row_id, F.col(box).alias("_a")).join(other, on).where((F.col(row_id) != F.col("_id")) & touch)

    def span(at: str, size: str) -> tuple[Column, Column]:
        step = F.greatest(a[size], F.lit(1e-9)) / grid
        first, last = (b[at] - a[at]) / step - 0.5, (b[at] + b[size] - a[at]) / step - 0.5
        return F.greatest(F.lit(0), F.ceil(F.greatest(first, F.lit(-1.0)) - 1e-9)).cast("int"), F.least(F.lit(grid - 1), F.floor(F.least(last, F.lit(float(grid))) + 1e-9)).cast("int")

    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    (left, right), (top, down) = span("x", "w"), span("y", "h")
    spans = pairs.select(*on, row_id, left.alias("_l"), right.alias("_r"), top.alias("_t"), down.alias("_d"))
    masks = spans.select(*on, row_id, F.when(F.col("_l") <= F.col("_r"), bit(F.col("_r") + 1) - bit(F.col("_l"))).alias("_c"), "_t", "_d")
    rows = [F.bit_or(F.when(F.lit(k).between(F.col("_t"), F.col("_d")), F.col("_c"))) for k in range(grid)]
    n = functools.reduce(lambda x, y: x + y, (F.coalesce(F.bit_count(r), F.lit(0)) for r in rows))
    covered = masks.groupBy(*on, row_id).agg(n.alias("_n"))
    return df.select(*on, row_id).join(covered, [*on, row_id], "left").select(*on, row_id, (F.coalesce("_n", F.lit(0)) / float(grid * grid)).alias("occlusion"))


def possession(points: DataFrame, boxes: DataFrame, on: list[str], track: str, box: str, x: Column, y: Column, aside: float = 0.1, above: float = 0.1, down_to: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """(track, frames): in how many frames some point lies in a track's box, grown by shares of its width to both sides and
    of its height upwards, and cut below at a share of its height: a ball at the feet isn't held. `by` are columns of the
    points that the frames are counted for."""
    by = by or []
    b = F.col(box)
    inside = x.between(b["x"] - aside * b["w"], b["x"] + (1 + aside) * b["w"]) & y.between(b["y"] - above * b["h"], b["y"] + down_to * b["h"])
    return boxes.join(points, on).where(inside).select(*on, *by, track).distinct().groupBy(*[c for c in on if c != "frame"], *by, track).agg(F.count("*").alias("frames"))


def nearest_other(df: DataFrame, on: list[str], row_id: str, x: str, y: str) -> DataFrame:
    """For each row the distance to the nearest other row of its frame; null without one."""
    other = df.select(*on, F.col(row_id).alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = df.select(*on, row_id, x, y).join(other, on).where(F.col(row_id) != F.col("_id"))
    found = pairs.groupBy(*on, row_id).agg(F.min(F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))).alias("nearest"))
    return df.select(*on, row_id).join(found, [*on, row_id], "left")


def greedy_boxes(truth: DataFrame, found: DataFrame, on: list[str], truth_id: str, truth_box: str, found_id: str, found_box: str, least: float = 0.5) -> DataFrame:
    """(on, truth_id, found_id): true boxes in order of id each take the best box that is still free, with IoU >= least.

    A frame's pairs are few, so the order-dependent choice is a fold over them.
    """
    pairs = truth.select(*on, truth_id, F.col(truth_box).alias("_a")).join(found.select(*on, found_id, F.col(found_box).alias("_b")), on).withColumn("_i", iou(F.col("_a"), F.col("_b"))).where(F.col("_i") >= least)
    rows = pairs.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col(truth_id).alias("t"), (-F.col("_i")).alias("i"), F.col(found_id).alias("f")))).alias("_r"))
    free = lambda s, r: ~F.exists(s, lambda k: (k["t"] == r["t"]) | (k["f"] == r["f"]))
    taken = F.aggregate("_r", F.slice("_r", 1, 0), lambda s, r: F.when(free(s, r), F.concat(s, F.array(r))).otherwise(s))
    return rows.select(*on, F.explode(taken).alias("k")).select(*on, F.col("k.t").alias(truth_id), F.col("k.f").alias(found_id))
