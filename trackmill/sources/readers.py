"""Readers of event tables, detections, labels, calibrations and models."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.functions.geometry import cm_to_court
from trackmill.functions.values import flag, integers_in, or_default, pairs_in
from trackmill.operators.sequences import only_once

EVENT_COLUMNS = ["event_id", "timestamp_s", "frame", "team", "zone", "made", "points", "court_x", "court_y", "confidence", "player", "shooter_track"]
DETECTIONS = "video string, frame int, x float, y float, w float, h float, conf float, src int"
LABEL_COLUMNS = ["event_id", "timestamp_s", "frame", "team", "zone", "made", "note"]
CALIBRATION = "court_standard string, image_size array<int>, image_points array<array<double>>, court_points array<array<double>>, rim_center array<double>, rim_edge array<array<double>>, note string, landmark_names array<string>"
# Court corners of the outdoor recordings in centimetres, by the names of their keypoints.
OUTDOOR_CORNERS = {"rku_0": (0, 0), "rku_1": (0, 1105), "rku_10": (1505, 0), "rku_11": (1505, 1105)}


def read_detections(spark: SparkSession, path: str, pattern: str = "chunk_*.parquet") -> DataFrame:
    """Detections of Parquet chunks below path/video=.../, with det_seq: a video's rows in the order of the chunks' names.

    The order is that of (name, row in the file), so it doesn't depend on how the files are split among tasks. No chunk at
    all raises, as does a path that isn't there.
    """
    raw = spark.read.schema(DETECTIONS).option("pathGlobFilter", pattern).parquet(path)
    if raw.limit(1).inputFiles() == []:
        raise FileNotFoundError(f"no chunks {pattern} below {path}")
    placed = raw.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    seq = (F.row_number().over(Window.partitionBy("video").orderBy("_file", "_row")) - 1).cast("long")
    return placed.select("video", seq.alias("det_seq"), *[c for c in raw.columns if c != "video"])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels as strings, all of LABEL_COLUMNS whichever the file has; no rows if there is no file yet."""
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], ",".join(f"{c} string" for c in LABEL_COLUMNS))
    by = [c for c in ("video",) if c in raw.columns]
    return raw.select(*by, *((F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in LABEL_COLUMNS))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from CSV with a header, any of its columns left out; blanks take defaults, an unknown zone or team raises."""
    raw = spark.read.option("header", True).csv(path)
    text = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    number = lambda c, kind, default: or_default(text(c), F.lit(default).cast("string")).cast(kind)
    known = lambda c, names, default: F.when((v := or_default(text(c), F.lit(default))).isin(names), v).otherwise(F.raise_error(F.concat(F.lit(f"unknown {c}: "), v)))
    order = F.row_number().over(Window.partitionBy("_file").orderBy("_place")) - 1
    rows = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_place", F.monotonically_increasing_id())
    return rows.select(
        F.coalesce(or_default(text("event_id"), F.lit(None)).cast("int"), order).alias("event_id"), number("timestamp_s", "double", 0).alias("timestamp_s"), number("frame", "int", -1).alias("frame"),
        known("team", ["A", "B", "?"], "?").alias("team"), known("zone", ["inside_arc", "beyond_arc", "ft"], "inside_arc").alias("zone"), flag(text("made")).alias("made"), number("points", "int", 0).alias("points"),
        or_default(text("court_x"), F.lit(None)).cast("double").alias("court_x"), or_default(text("court_y"), F.lit(None)).cast("double").alias("court_y"), number("confidence", "double", 1).alias("confidence"),
        F.coalesce(text("player"), F.lit("")).alias("player"), or_default(text("shooter_track"), F.lit(None)).cast("int").alias("shooter_track"),
    )


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """Boxes from headless CSV lines (frame, id, x, y, w, h, score); lines of fewer than six fields are left out."""
    f = F.split("value", ",")
    real = lambda k: F.get(f, F.lit(k)).cast("double")
    return spark.read.text(path).where(F.size(f) >= 6).select(real(0).cast("int").alias("frame"), real(1).cast("int").alias("track_id"), *(real(k + 2).alias(n) for k, n in enumerate("xywh")), F.coalesce(F.get(f, F.lit(6)).try_cast("double"), F.lit(1.0)).alias("score"))


# Fixed values of the game-flow format: a row's first field, and an "id: number" pair.
FLOW_HEAD, FLOW_PAIR = r"^\s*(\d+)\s*\((.*)\)\s*$", r"(\d+)\s*:\s*(\d+)"


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    """Game-flow rows `frame (label), jersey pairs, sides`; other rows are left out. The third field, the sides, is split at
    its first ';'; rows without it have no sides."""
    rows = spark.read.option("multiLine", True).option("ignoreLeadingWhiteSpace", True).csv(path, schema="c0 string, c1 string, c2 string").where(F.col("c0").rlike(FLOW_HEAD))
    side = lambda k: integers_in(F.coalesce(F.get(F.split("c2", ";", 2), F.lit(k)), F.lit("")))
    label = F.trim(F.regexp_replace(F.regexp_extract("c0", FLOW_HEAD, 2), r"\s+", " "))
    return rows.select(F.regexp_extract("c0", FLOW_HEAD, 1).cast("int").alias("frame"), label.alias("label"), pairs_in(F.coalesce("c1", F.lit(""))).alias("jersey"), side(0).alias("offense"), side(1).alias("defense"))


def team_membership(flow: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, team) from the first row with an offense: A is the offense, B the defense, which wins for ids in both."""
    first = flow.where(F.size("offense") > 0).groupBy(*by).agg(F.min(F.struct("frame", "offense", "defense")).alias("f"))
    both = F.concat(F.transform("f.offense", lambda i: F.struct(i.alias("id"), F.lit("A").alias("team"))), F.transform("f.defense", lambda i: F.struct(i.alias("id"), F.lit("B").alias("team"))))
    return first.select(*by, F.inline(both)).groupBy(*by, "id").agg(F.max("team").alias("team"))


def read_keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, fields of value) from files that hold one JSON object keyed by image or event; value is a struct's DDL."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("key", "v")).select("key", "v.*")


def read_calibrations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row of CALIBRATION's fields for each JSON file (file), the rim null where there is none; or for each line of files that
    name the video in it (`lines`, video).

    Fewer than four pairs of points, or not as many in the image as on the court, raise.
    """
    if lines:
        found = spark.read.text(path).select(F.from_json("value", f"video string, {CALIBRATION}").alias("c")).select("c.*")
        return _checked(found, "video")
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", CALIBRATION).alias("c"))
    return _checked(whole.select("file", "c.*"), "file")


def _checked(found: DataFrame, name: str) -> DataFrame:
    n, m = (F.coalesce(F.size(f"{k}_points"), F.lit(-1)) for k in ("image", "court"))
    bad = F.concat(F.lit("a calibration takes four or more pairs of points: "), F.coalesce(F.col(name), F.lit("?")))
    return found.withColumn("_ok", F.when((n < 4) | (n != m), F.raise_error(bad).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")


def outdoor_calibration(keypoints: DataFrame) -> DataFrame:
    """The calibration (CALIBRATION's fields, no rim) of the outdoor recordings from their keypoints (name, x, y)."""
    corners = F.explode(F.array(*(F.struct(F.lit(k).alias("i"), F.lit(n).alias("name"), F.lit(float(x)).alias("cx"), F.lit(float(y)).alias("cy")) for k, (n, (x, y)) in enumerate(OUTDOOR_CORNERS.items()))))
    known = keypoints.sparkSession.range(1).select(corners.alias("c")).select("c.*")
    at = cm_to_court(F.col("cx"), F.col("cy"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "name", F.array("x", "y").alias("image"), F.array(at["x"], at["y"]).alias("court"))))
    found = keypoints.join(F.broadcast(known), "name").agg(pairs.alias("p"))  # four names at most
    none = lambda kind: F.lit(None).cast(kind)
    return found.select(
        F.lit("fiba_3x3").alias("court_standard"), F.array(F.lit(3840), F.lit(2160)).alias("image_size"), F.col("p.image").alias("image_points"), F.col("p.court").alias("court_points"),
        none("array<double>").alias("rim_center"), none("array<array<double>>").alias("rim_edge"), F.lit("from outdoor court keypoints").alias("note"), F.col("p.name").alias("landmark_names"),
    )


def read_model(text: str, features: list[str]) -> dict:
    """A model's parameters from JSON; one that was fitted on other features raises."""
    model = json.loads(text)
    if model["features"] != features:
        raise ValueError("the model was fitted on other features")
    return model


def read_index(spark: SparkSession, paths: list[str], schema: str, key: str = "file") -> DataFrame:
    """The rows of several CSV files whose key occurs once; keys that occur more often are left out altogether."""
    return only_once(spark.read.option("header", True).csv(paths, schema=schema), [key])


def read_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y) from the first line of a newline-delimited JSON export: its first project's first label's points."""
    point = "struct<name:string,value:string,point:struct<x:double,y:double>>"
    label = f"struct<annotations:struct<objects:array<{point}>>>"
    first = spark.read.json(path, schema=f"projects map<string,struct<labels:array<{label}>>>").limit(1)
    objects = F.get(F.get(F.map_values("projects"), F.lit(0))["labels"], F.lit(0))["annotations"]["objects"]
    return first.select(F.explode(objects).alias("o")).select(F.coalesce("o.value", "o.name").alias("name"), "o.point.x", "o.point.y")


def read_video_info(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, fps, n_frames, duration_s, codec) from probe reports in JSON, one a file.

    The rate is a fraction; where the number of frames isn't told it is the rounded duration times rate.
    """
    stream = "struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,nb_frames:string,duration:string>"
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"streams array<{stream}>, format struct<duration:string>").alias("j"))
    s = F.get(F.filter("j.streams", lambda v: F.coalesce(v["codec_type"], F.lit("video")) == "video"), F.lit(0))
    rate = F.split(s["r_frame_rate"], "/")
    fps = F.try_divide(F.get(rate, F.lit(0)).cast("double"), F.coalesce(F.get(rate, F.lit(1)).cast("double"), F.lit(1.0)))
    seconds = F.coalesce(s["duration"].try_cast("double"), F.col("j.format.duration").try_cast("double"))
    return whole.select("file", s["width"].alias("width"), s["height"].alias("height"), fps.alias("fps"), F.coalesce(s["nb_frames"].try_cast("long"), F.round(seconds * fps).cast("long")).alias("n_frames"), seconds.alias("duration_s"), s["codec_name"].alias("codec"))
