"""The whole run: detections of the ball and the players in, shot events and their tables out, for all videos at once."""

from __future__ import annotations

import time

import pyspark
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from trackmill.functions import court as courts
from trackmill.operators.aggregates import player_table, zone_statistics
from trackmill.operators.common import Stages, scratch
from trackmill.operators.composites import SHOT, assign_numbers, shooter_info, shot_teams, track_teams
from trackmill.operators.matching import in_window, one_to_one
from trackmill.operators.review import RELEASE_AFTER_S
from trackmill.operators.sequences import clean_views, every_nth
from trackmill.operators.shots import detect_shots
from trackmill.operators.spatial import overlap_of_others
from trackmill.operators.tracking import ball_track
from trackmill.sources import writers


def shot_numbers(info: DataFrame, teams: DataFrame, persons: DataFrame, crops: DataFrame, numbers: list[int]) -> DataFrame:
    """(video, shot, number) by the vote over the shooter's crops (video, track, frame, probs) near the release."""
    shooters = info.where("track is not null").select(*SHOT, "release", "track")
    own = every_nth(in_window(shooters, crops.select("video", "track", "frame", "probs"), ["video", "track"], "release", "frame", 45, 15), SHOT, "frame", 3)
    seen = persons.join(own.select("video", "frame").distinct(), ["video", "frame"], "left_semi")
    covered = overlap_of_others(seen.select("video", "frame", "track", "box"), ["video", "frame"], "track", "box")
    views = clean_views(own.join(covered, ["video", "frame", "track"]), SHOT, "frame", "release", "overlap")
    every = teams.select(*SHOT, "team").join(views.select(*SHOT, "probs"), SHOT, "left")
    return assign_numbers(every, numbers).select(*SHOT, "number")


def analyze(detections: DataFrame, persons: DataFrame, cameras: DataFrame, standard: str, rules: str = "3x3", fps: float = 30000 / 1001, label: str = "label", keyframes: DataFrame | None = None, crops: DataFrame | None = None, numbers: list[int] | None = None, model: dict | None = None, stages: Stages | None = None) -> DataFrame:
    """Shot events (video and the columns of events) of all videos.

    detections: (video, det_seq, frame, x, y, w, h, conf) of the ball; persons: (video, frame, track, box, label), label the
    team that a player's colours give ('?' if neither); cameras: a row a video (video, h, rx, ry, rr) with the homography as
    nine numbers; keyframes: (video, frame) at which a track's team is voted on, by default each 30th; crops: (video, track,
    frame, probs), without which players stay blank. A video without shots has no events, one without a camera none either;
    a shot without a shooter has team '?', zone inside_arc and no place. The track, the shots and the shooters are written
    once below spark.checkpoint.dir, as several later steps read each; `stages` keeps how long each took, and its rows.
    """
    stages = stages or Stages()
    spark, c, h = detections.sparkSession, courts.court(standard), F.col("h")
    folder = scratch(spark)
    people = persons.select("video", "frame", "track", "box", label).join(cameras.select("video", "h"), "video")
    track = stages.written("track", ball_track(detections), f"{folder}/track")
    found = detect_shots(track, cameras, fps, model)
    shots = stages.written("shots", found.withColumn("shot", F.row_number().over(Window.partitionBy("video").orderBy("release")) - 1), f"{folder}/shots")
    info = stages.written("shooters", shooter_info(shots, people, track, h, c, fps), f"{folder}/shooters")
    looks = keyframes if keyframes is not None else people.where("frame % 30 = 0").select("video", "frame").distinct()
    teams = shot_teams(info, people, label, track_teams(people, looks, h, c, F.col(label)))
    rows = shots.select(*SHOT, "release", "made", "confidence").join(info.drop("release"), SHOT, "left").join(teams, SHOT, "left")
    if crops is None:
        rows = rows.withColumn("number", F.lit(""))
    else:
        rows = rows.join(shot_numbers(info, teams, people, crops, numbers or []), SHOT, "left")
    at = (F.col("release") + round(RELEASE_AFTER_S * fps)).cast("int")
    zone = F.coalesce("zone", F.lit("inside_arc"))
    return rows.select(
        "video", F.col("shot").cast("int").alias("event_id"), F.round(at / F.lit(float(fps)), 3).alias("timestamp_s"), at.alias("frame"), F.coalesce("team", F.lit("?")).alias("team"),
        zone.alias("zone"), "made", courts.points_for(F.lit(rules), zone, F.col("made")).alias("points"), F.round("court_x", 2).alias("court_x"), F.round("court_y", 2).alias("court_y"),
        F.round("confidence", 3).alias("confidence"), F.coalesce("number", F.lit("?")).alias("player"), F.col("track").cast("int").alias("shooter_track"),
    )


def shot_features(shots: DataFrame, labels: DataFrame, fps: float = 30000 / 1001, tolerance: float = 1.0) -> DataFrame:
    """(video, event_id, at, label_made, label_zone, pred_made, features) of labelled shots (video, event_id, timestamp_s, made,
    zone) and the found ones that match them: the rows that a make model is fitted on."""
    gt = labels.select("video", "event_id", F.col("timestamp_s").alias("at"), F.col("made").alias("label_made"), F.col("zone").alias("label_zone"))
    found = shots.select("video", "release", (F.col("release") / F.lit(float(fps))).alias("release_at"), F.col("made").alias("pred_made"), "features")
    pairs = one_to_one(gt, found, ["video"], "event_id", "release", "at", "release_at", tolerance).select("video", "event_id", "release")
    return pairs.join(gt, ["video", "event_id"]).join(found.drop("release_at"), ["video", "release"]).drop("release")


def write_run(events: DataFrame, path: str, settings: dict[str, str], started: float | None = None, stages: Stages | None = None) -> None:
    """events, stats and players below path, each by video, and run_log: a line of JSON a video with its shots, known numbers
    by team, the settings, the versions, the seconds since `started` (time.time()) and the stages of the run, those of all
    videos together (analyze's if it was given the same `stages`, the events and the other outputs). The rules that zones
    are named by are settings["rules"], or 3x3."""
    stages, start, seen = stages or Stages(), time.monotonic(), Observation("events")
    writers.write_events(events.observe(seen, F.count(F.lit(1)).alias("n_rows")), f"{path}/events")
    stages.lap("events", start, seen.get["n_rows"])
    start = time.monotonic()
    kept = events.sparkSession.read.option("header", True).schema(",".join(f"{f.name} {f.dataType.simpleString()}" for f in events.withColumn("made", F.col("made").cast("int")).select(*writers.EVENT_COLUMNS, "video").schema)).csv(f"{path}/events")
    kept = kept.withColumn("player", F.coalesce("player", F.lit("")))
    players = player_table(kept, by=["video"])
    tried = kept.where("player <> ''").select("video").distinct()
    writers.write_statistics(zone_statistics(kept, "team", "zone", F.col("made"), F.col("points"), courts.ZONES, by=["video"]), settings.get("rules", "3x3"), f"{path}/stats", players.join(tried, "video", "left_semi"))
    writers.write_players(players, f"{path}/players")
    known = F.when(~F.col("player").isin("", "?"), F.struct("team", "player"))
    text = lambda d: F.create_map(*(F.lit(str(v)) for kv in sorted(d.items()) for v in kv)) if d else F.lit(None)
    log = kept.groupBy("video").agg(F.count("*").alias("n_shots"), F.array_sort(F.collect_set(known)).alias("numbers"))
    stages.lap("outputs", start, seen.get["n_rows"])
    kept_stages = F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(t).alias("seconds"), F.lit(k).cast("long").alias("n_rows")) for n, t, k in stages.records))
    spent: Column = F.lit(None if started is None else round(time.time() - started, 1)).cast("double")
    log.select("video", "n_shots", "numbers", text(settings).alias("settings"), F.lit(pyspark.__version__).alias("spark"), spent.alias("processing_s"), kept_stages.alias("stages")).write.mode("overwrite").json(f"{path}/run_log")
