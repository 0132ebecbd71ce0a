"""The whole run on made-up flights, and the tables it writes."""

import json
import time

from pyspark.sql import functions as F

from tests.test_operators import flight
from trackmill.functions.court import court
from trackmill.operators import analysis
from trackmill.operators.common import Stages
from trackmill.operators.shots import detect_shots
from trackmill.sources import readers

PERSON = "video string, frame int, track int, box struct<x:double,y:double,w:double,h:double>, label string"
H = [0.01, 0.0, -14.0, 0.0, 0.01, -7.5, 0.0, 0.0, 1.0]  # x 1400 is the middle, y 750 the baseline


def parts(spark):
    rows, seq = [], 0
    for video in ("v", "w"):
        for f, x, y in flight(90, 1400.0, 2140.0, 150, 1200.0) + (flight(300, 1700.0, 2440.0, 150, 1200.0) if video == "v" else []):
            rows.append((video, seq, f, x - 17, y - 17, 34.0, 34.0, 0.8))
            seq += 1
    detections = spark.createDataFrame(rows, "video string, det_seq long, frame int, x double, y double, w double, h double, conf double")
    at = lambda v, f, t, x, label: (v, f, t, (x - 40, 1150.0, 80.0, 200.0), label)
    people = [at(v, f, t, 1400.0 + 300 * (t - 1), "A" if t == 1 else "B") for v in "vw" for f in range(0, 421, 3) for t in (1, 2)]
    cameras = spark.createDataFrame([(v, H, 1800.0, 840.0, 33.0) for v in "vwz"], "video string, h array<double>, rx double, ry double, rr double")
    return detections, spark.createDataFrame(people, PERSON), cameras


def test_analyze_and_its_files(spark, tmp_path):
    detections, persons, cameras = parts(spark)
    crops = persons.select("video", "track", "frame", F.when(F.col("track") == 1, F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.array(F.lit(0.2), F.lit(0.8))).alias("probs"))
    started = time.time()
    stages = Stages()
    events = analysis.analyze(detections, persons, cameras, "fiba_3x3", fps=30.0, crops=crops, numbers=[7, 12], stages=stages)
    assert events.columns == ["video", *readers.EVENT_COLUMNS]
    got = {(r.video, r.event_id): r for r in events.collect()}
    assert sorted(got) == [("v", 0), ("v", 1), ("w", 0)]
    assert [(got[k].team, got[k].player, got[k].shooter_track) for k in sorted(got)] == [("A", "7", 1), ("B", "12", 2), ("A", "7", 1)]
    first = got["v", 0]
    assert first.court_x == 0.0 and first.court_y == 6.0 and abs(first.frame - 102) <= 2 and first.timestamp_s == round(first.frame / 30, 3)
    assert all(r.points == (0 if not r.made else 2 if r.zone == "beyond_arc" else 1) for r in got.values())
    plain = analysis.analyze(detections, persons, cameras, "fiba_3x3", fps=30.0)
    assert {r.player for r in plain.collect()} == {""}
    empty = analysis.analyze(detections.where("false"), persons.where("false"), cameras.where("false"), "fiba_3x3", fps=30.0)
    assert empty.count() == 0

    path = str(tmp_path / "run")
    analysis.write_run(events, path, {"rules": "3x3", "standard": "fiba_3x3"}, started, stages)
    assert readers.read_events(spark, f"{path}/events").count() == 3
    log = {r.video: r for r in spark.read.json(f"{path}/run_log").collect()}
    assert (log["v"].n_shots, log["w"].n_shots) == (2, 1) and log["v"].settings.rules == "3x3" and log["v"].processing_s > 0
    assert [(s.stage, s.n_rows) for s in log["v"].stages if s.stage != "track"] == [("shots", 3), ("shooters", 3), ("events", 3), ("outputs", 3)]
    assert all(s.seconds > 0 for s in log["w"].stages) and log["v"].stages[0].n_rows >= 150
    assert [(n.team, n.player) for n in log["v"].numbers] == [("A", "7"), ("B", "12")]
    stats = {r.video: json.loads(r.value) for r in spark.read.text(f"{path}/stats").collect()}
    assert stats["v"]["rules"] == "3x3" and stats["v"]["total"]["overall"]["attempts"] == 2 and sorted(stats["v"]["teams"]) == ["A", "B"]
    assert stats["w"]["teams"]["A"]["FT"]["attempts"] in (0, 1) and "B" not in stats["w"]["teams"] and [p["number"] for p in stats["v"]["players"]] == ["7", "12"]
    assert spark.read.option("header", True).csv(f"{path}/players").count() == 3


def test_features_of_shots_and_a_model(spark):
    track = spark.createDataFrame([("v", f, x, y, 35.0) for f, x, y in flight(100, 1400.0, 2140.0, 300) + flight(300, 1700.0, 2440.0, 300)], "video string, frame int, x double, y double, size double")
    rims = spark.createDataFrame([("v", 1800.0, 840.0, 33.0)], "video string, rx double, ry double, rr double")
    model = {"mean": [0.0] * 9, "std": [1.0] * 9, "w": [-1.0] + [0.0] * 8, "b": 3.0, "threshold": 0.5}
    rows = detect_shots(track, rims, model=model).orderBy("release").collect()
    for r in rows:
        assert len(r.features) == 9 and r.features[0] == abs(r.dx) / 33 and r.made == (abs(r.dx) / 33 <= 3.0)
        assert abs(r.features[8] - 35.0 / (2 * 33 * 0.53)) < 1e-9 and r.features[4] == -300.0
        assert r.features[1] > 0 and r.features[2] > 0  # falls on, faster
    labels = spark.createDataFrame([("v", 5, 3.5, True, "ft"), ("v", 6, 40.0, False, "ft")], "video string, event_id int, timestamp_s double, made boolean, zone string")
    pairs = analysis.shot_features(detect_shots(track, rims, model=model), labels, fps=30.0).collect()
    assert [(p.event_id, p.label_made, p.label_zone, len(p.features)) for p in pairs] == [(5, True, "ft", 9)]
    assert court("fiba_3x3").hoop_y > 0
