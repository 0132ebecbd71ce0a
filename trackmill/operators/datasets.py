"""Tables that training sets and check sheets are cut from: torso crops, label lines, the court's lines in the image."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.functions.court import court_lines
from trackmill.functions.geometry import clipped_box, project, torso
from trackmill.operators.sequences import evenly_spaced
from trackmill.operators.spatial import occlusion

LEAST_HEIGHT = 150  # fixed value: a smaller box is a partial or far player


def crop_index(boxes: DataFrame, players: DataFrame, every: int = 1, least: float = LEAST_HEIGHT) -> DataFrame:
    """(file, video, frame, track, team, number, occl, box_w, box_h): the crops of a training set of numbers.

    boxes: (video, frame, track, box) with each frame's players; players: (video, track, team, number), a track once.
    Tracks without a number, boxes lower than `least`, and tracks that stand more than once in a frame are left out, but
    still hide others. occl is the share of the torso that the frame's other boxes hide.
    """
    sampled = boxes.where(F.pmod("frame", F.lit(every)) == 0).select("video", "frame", "track", "box", torso(F.col("box")).alias("_torso"))
    hidden = occlusion(sampled, ["video", "frame"], "track", "_torso", others="box").groupBy("video", "frame", "track").agg(F.max("occlusion").alias("occl"))
    single = sampled.groupBy("video", "frame", "track").agg(F.count("*").alias("_n"), F.first("box").alias("box")).where((F.col("_n") == 1) & (F.col("box.h") >= least))
    rows = single.join(players.where("number is not null").select("video", "track", "team", "number"), ["video", "track"]).join(hidden, ["video", "frame", "track"])
    size = lambda c: F.bround(F.col(c)).cast("int")
    return rows.select(F.format_string("%s_f%06d_t%d.jpg", F.col("video").cast("string"), F.col("frame").cast("int"), F.col("track").cast("int")).alias("file"), "video", "frame", "track", F.coalesce("team", F.lit("")).alias("team"), "number", F.round("occl", 3).alias("occl"), size("box.w").alias("box_w"), size("box.h").alias("box_h"))


def label_line(box: Column, left: Column, top: Column, width: int, height: int) -> Column:
    """A detector's label line of a box in a crop: class 0, then centre and size in shares of the crop."""
    b = clipped_box(box, left, top, width, height)
    return F.format_string("0 %.6f %.6f %.6f %.6f", b["cx"], b["cy"], b["w"], b["h"])


def sheet_tiles(spans: DataFrame, boxes: DataFrame, players: DataFrame, frames: int = 12, margin: int = 30) -> DataFrame:
    """(video, frame, place, track, caption, crop): the tiles of sheets that show whether numbers can be read.

    spans: (video, first, last); frames are spread evenly between margin after the first and before the last. A crop is the
    upper 60 hundredths of a player's box, tiles go by team, then track.
    """
    from pyspark.sql import Window

    inner = spans.select("video", (F.col("first") + margin).alias("_a"), (F.col("last") - margin).alias("_b"))
    wanted = evenly_spaced(inner, "_a", "_b", frames, "frame").select("video", "frame").distinct()
    rows = boxes.join(wanted, ["video", "frame"]).join(players.select("video", "track", "team", "number"), ["video", "track"], "left")
    b, team = F.col("box"), F.coalesce("team", F.lit("?"))
    whole = lambda v: v.cast("int")
    crop = F.struct(whole(b["x"]).alias("x"), whole(b["y"]).alias("y"), (whole(b["x"] + b["w"]) - whole(b["x"])).alias("w"), (whole(b["y"] + 0.6 * b["h"]) - whole(b["y"])).alias("h"))
    rows = rows.select("video", "frame", "track", team.alias("_team"), F.coalesce(F.col("number").cast("string"), F.lit("?")).alias("_no"), crop.alias("crop"))
    place = F.row_number().over(Window.partitionBy("video", "frame").orderBy("_team", "track")) - 1
    return rows.select("video", "frame", place.alias("place"), "track", F.format_string("%s #%s (%dx%d)", "_team", "_no", "crop.w", "crop.h").alias("caption"), "crop")


def tile_sizes(tiles: DataFrame) -> DataFrame:
    """(video, frames, crops, and the median, least and most width and height of a crop)."""
    of = lambda f, n: [f(f"crop.{c}").alias(f"{n}_{c}") for c in ("w", "h")]
    return tiles.groupBy("video").agg(F.countDistinct("frame").alias("frames"), F.count("*").alias("crops"), *of(F.median, "median"), *of(F.min, "least"), *of(F.max, "most"))


def court_overlay(spark: SparkSession, name: str, to_image) -> DataFrame:
    """(line, seq, x, y): the court's lines in the image, by the homography from the court (nine numbers)."""
    p = project(to_image, F.col("x"), F.col("y"))
    return court_lines(spark, name).select("line", "seq", p.alias("_p")).select("line", "seq", "_p.x", "_p.y")


def court_overlays(cameras: DataFrame, name: str) -> DataFrame:
    """(video, line, seq, x, y): the court's lines (a few hundred points) in each video's image; cameras: (video, to_image), the
    homography from the court as nine numbers."""
    lines = json.dumps([r.asDict() for r in court_lines(cameras.sparkSession, name).collect()])
    each = F.explode(F.from_json(F.lit(lines), "array<struct<line:string,seq:int,x:double,y:double>>"))
    p = project(F.col("to_image"), F.col("l.x"), F.col("l.y"))
    return cameras.select("video", "to_image", each.alias("l")).select("video", "l.line", "l.seq", p.alias("_p")).select("video", "line", "seq", "_p.x", "_p.y")
