"""Readers and writers against small files, and the tables that reviews are made from."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from trackmill.functions import court, geometry
from trackmill.operators import aggregates, composites, matching, review, spatial
from trackmill.sources import readers, writers


def test_detections_in_order_of_chunks(spark, tmp_path):
    rows = [("v", k, float(k), 0.0, 9.0, 9.0, 0.5, 0) for k in range(6)] + [("w", 9, 0.0, 0.0, 9.0, 9.0, 0.5, 0)]
    df = spark.createDataFrame(rows, readers.DETECTIONS)
    for name, part in (("chunk_000010", df.where("video = 'v' and frame < 3")), ("chunk_000002", df.where("frame >= 3"))):
        part.coalesce(1).write.partitionBy("video").parquet(str(tmp_path / name))
        for file in (tmp_path / name).glob("video=*/part-*.parquet"):
            folder = tmp_path / "all" / file.parent.name
            folder.mkdir(parents=True, exist_ok=True)
            file.rename(folder / f"{name}.parquet")
    got = readers.read_detections(spark, str(tmp_path / "all")).orderBy("video", "det_seq").collect()
    assert [(r.video, r.det_seq, r.frame) for r in got] == [("v", 0, 3), ("v", 1, 4), ("v", 2, 5), ("v", 3, 0), ("v", 4, 1), ("v", 5, 2), ("w", 0, 9)]
    with pytest.raises(FileNotFoundError):
        readers.read_detections(spark, str(tmp_path / "all"), "none_*.parquet")


def test_labels_are_strings(spark, tmp_path):
    assert readers.read_labels(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "v.csv").write_text("event_id,timestamp_s,frame,team,zone,made,note\n0,1.50,45,A,ft,,auto\n1,2,60,B,ft,1,\n")
    rows = readers.read_labels(spark, str(tmp_path / "v.csv"))
    assert rows.columns == readers.LABEL_COLUMNS and set(dict(rows.dtypes).values()) == {"string"}
    assert [(r.timestamp_s, r.made, r.note) for r in rows.orderBy("event_id").collect()] == [("1.50", None, "auto"), ("2", "1", None)]
    done = rows.select("event_id", review.is_complete(F.col("team"), F.col("made"), F.col("note")).alias("c")).orderBy("event_id").collect()
    assert [r.c for r in done] == [False, True]
    labels = spark.createDataFrame([("v", 5.0, "A"), ("v", 1.0, "B"), ("w", 2.0, "A")], "video string, timestamp_s double, team string").withColumn("event_id", F.lit(9))
    writers.write_labels(labels, ["video"], str(tmp_path / "out"))
    got = spark.read.option("header", True).csv(str(tmp_path / "out"), inferSchema=True).orderBy("video", "event_id").collect()
    assert [(r.video, r.event_id, r.team) for r in got] == [("v", 0, "B"), ("v", 1, "A"), ("w", 0, "A")]


def test_statistics_have_the_rules_names(spark):
    df = spark.createDataFrame([("A", "inside_arc", True, 1, "7"), ("A", "ft", False, 0, "?"), ("?", "beyond_arc", True, 2, "10")], "team string, zone string, made boolean, points int, player string")
    stats = aggregates.zone_statistics(df, "team", "zone", F.col("made"), F.col("points"), court.ZONES)
    got = json.loads(writers.statistics(stats, "3x3", aggregates.player_table(df)).first().value)
    assert got["rules"] == "3x3" and list(got["teams"]) == ["?", "A"]
    assert got["teams"]["A"] == {"1PT": {"attempts": 1, "made": 1, "pct": 1.0}, "2PT": {"attempts": 0, "made": 0, "pct": None}, "FT": {"attempts": 1, "made": 0, "pct": 0.0}, "overall": {"attempts": 2, "made": 1, "pct": 0.5}, "points": 1}
    assert got["total"]["points"] == 3 and got["total"]["overall"] == {"attempts": 3, "made": 2, "pct": 0.667}
    assert [(p["team"], p["number"], p["makes"]) for p in got["players"]] == [("A", "7", 1), ("A", "?", 0), ("?", "10", 1)]
    plain = json.loads(writers.statistics(stats, "5v5").first().value)
    assert "players" not in plain and set(plain["teams"]["A"]) == {"2PT", "3PT", "FT", "overall", "points"}


def test_keyed_decisions_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("v", "10", "ok", 3), ("v", "9", "skip", None), ("w", "1", "ok", 1)], "video string, key string, status string, track int")
    assert [r.value for r in writers.keyed_json(rows, ["video"], "key", True).orderBy("video").collect()] == ['{"9":{"status":"skip"},"10":{"status":"ok","track":3}}', '{"1":{"status":"ok","track":1}}']
    assert writers.keyed_json(rows, ["video"], "key").orderBy("video").first().value.startswith('{"10"')
    writers.write_keyed_json(rows, ["video"], "key", str(tmp_path / "d"), True)
    got = readers.read_keyed_json(spark, str(tmp_path / "d"), "status:string,track:int")
    assert {(r.key, r.status, r.track) for r in got.collect()} == {("10", "ok", 3), ("9", "skip", None), ("1", "ok", 1)}


def test_calibrations_and_models(spark, tmp_path):
    points = spark.createDataFrame([(n, float(k), 2.0 * k) for k, n in enumerate(["rku_11", "rku_0", "other", "rku_10", "rku_1"])], "name string, x double, y double")
    made = readers.outdoor_calibration(points)
    r = made.first()
    assert r.landmark_names == ["rku_0", "rku_1", "rku_10", "rku_11"] and r.image_points[0] == [1.0, 2.0] and r.court_points == [[7.525, 0.0], [7.525, 11.05], [-7.525, 0.0], [-7.525, 11.05]]
    writers.write_calibrations(made.withColumn("video", F.lit("v")), str(tmp_path / "c"))
    back = readers.read_calibrations(spark, str(tmp_path / "c")).first()
    assert back.court_points == r.court_points and back.rim_center is None and back.image_size == [3840, 2160]
    pathlib.Path(tmp_path / "bad.json").write_text('{"image_points": [[0, 0]], "court_points": [[0, 0]]}')
    with pytest.raises(Exception, match="four or more"):
        readers.read_calibrations(spark, str(tmp_path / "bad.json")).collect()
    model = {"mean": [0.5, 1], "std": [1, 2], "w": [0.1, -3], "b": 0.25, "threshold": 0.5}
    assert readers.read_model(writers.model_text(model, ["a", "b"]), ["a", "b"])["w"] == [0.1, -3.0]
    with pytest.raises(ValueError):
        readers.read_model(writers.model_text(model, ["a", "b"]), ["b", "a"])
    scaled = spark.range(1).select(geometry.scaled_points(F.array(F.array(F.lit(1.0), F.lit(2.0))), 0.5).alias("p")).first().p
    assert scaled == [[0.5, 1.0]]


def test_reviews(spark):
    shots = spark.createDataFrame([("v", 100, True), ("v", 7, False)], "video string, release int, made boolean")
    got = review.proposals(shots).orderBy("frame").collect()
    assert [(r.timestamp_s, r.frame, r.made, r.note, r.team) for r in got] == [("3.737", "112", "1", "auto", ""), ("0.634", "19", "0", "auto", "")]
    assert {r.made for r in review.proposals(shots, blank=True).collect()} == {""}
    items = spark.createDataFrame([("v", 0, "ok", 1, 2), ("v", 1, "ok", 2, 2), ("v", 2, None, None, 1), ("v", 3, "skip", None, 1), ("v", 4, "ok", None, 1), ("w", 5, "ok", 1, 1)], "video string, seq int, status string, track int, proposal int")
    r = {x.video: x for x in review.progress(items, ["video"], "status", ["ok", "skip"], F.col("track"), F.col("proposal")).collect()}
    assert (r["v"]["items"], r["v"].decided, r["v"].ok, r["v"].skip, r["v"].to_go, r["v"].changed) == (5, 4, 3, 1, 1, 2) and r["w"].changed == 0
    assert {x.video: x.seq for x in review.first_undecided(items, ["video"], "seq", "status").collect()} == {"v": 2, "w": 5}
    assert {x.video: x.seq for x in review.first_undecided(items, ["video"], "seq", "status", False).collect()} == {"v": 2, "w": None}
    labelled = matching.with_labels(items, spark.createDataFrame([("v", 1), ("v", 3)], "video string, q int"), ["video"], "q", F.lit(-1))
    assert labelled.count() == 6 and {(x.video, x.q) for x in labelled.collect()} == {("v", 3), ("w", -1)}


def test_owner_of_a_track_by_votes(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    at = lambda x: (float(x), 0.0, 10.0, 10.0)
    persons = spark.createDataFrame([("v", f, 1, at(0)) for f in (90, 97, 100, 112, 113)] + [("v", 100, 2, at(500))], f"video string, frame int, track int, box {box}")
    truth = spark.createDataFrame([("v", 90, 8, at(0)), ("v", 97, 5, at(2)), ("v", 97, 6, at(4)), ("v", 100, 6, at(1)), ("v", 112, 6, at(9)), ("v", 113, 8, at(0))], f"video string, frame int, gid int, true_box {box}")
    tracks = spark.createDataFrame([("v", 0, 100, 1), ("v", 1, 100, 2)], "video string, shot int, release int, track int")
    got = {r.shot: r.gid for r in spatial.track_owners(tracks, persons, truth, "gid", ["shot"]).collect()}
    assert got == {0: 5, 1: None}  # one vote each, and 5 came first


def test_possession_ranks_first(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    persons = spark.createDataFrame([("v", f, t, (200.0 * t, 0.0, 100.0, 200.0)) for f in range(0, 31, 3) for t in (1, 2)], f"video string, frame int, track int, box {box}")
    track = spark.createDataFrame([("v", f, 250.0, 100.0) for f in range(21, 31)], "video string, frame int, x double, y double")
    balls = spark.createDataFrame([("v", 12, 440.0, 90.0, 20.0, 20.0, 0.5), ("v", 9, 440.0, 90.0, 20.0, 20.0, 0.1), ("v", 12, 440.0, 190.0, 20.0, 20.0, 0.5)], "video string, frame int, x double, y double, w double, h double, conf double")
    shots = spark.createDataFrame([("v", 0, 21)], "video string, shot int, release int")
    held = {r.track: r.frames for r in composites.held_before(shots, persons, track, balls).collect()}
    assert held == {1: 1, 2: 1}
    near = spark.createDataFrame([("v", 0, 1, 0.0, 4), ("v", 0, 3, 0.5, 4)], "video string, shot int, track int, dist double, n long")
    ranked = composites.ranked_shooters(near, composites.held_before(shots, persons, track, balls)).orderBy("rank").collect()
    assert [r.track for r in ranked] == [1, 2, 3]


def test_coverage_ends_with_the_video(spark):
    shots = spark.createDataFrame([("v", 0), ("v", 8), ("v", 20)], "video string, start int")
    points = spark.createDataFrame([("v", f, float(f)) for f in (0, 1, 8)], "video string, frame int, d double")
    ends = spark.createDataFrame([("v", 10)], "video string, frames int")
    rows = aggregates.coverage(shots, points, ["video"], "start", 4, "frame", F.col("d"), ends)
    assert {r.start: (r.covered, r.nearest) for r in rows.collect()} == {0: (0.5, 0.0), 8: (0.5, 8.0), 20: (None, None)}
    s = aggregates.coverage_summary(rows, ["video"], F.lit(3.0), 0.5).first()
    assert (s.shots, s.median_covered, s.well_covered, s.reached) == (3, 0.5, 2, 1)
    q = spark.createDataFrame([(True, True, 19.0, 10.0), (True, True, 90.0, 10.0), (True, False, None, 10.0)], "t boolean, f boolean, e double, z double")
    r = aggregates.tracking_quality(q.withColumn("k", F.lit(1)), ["k"], "t", "f", "e", "z").first()
    assert (r.frames, round(r.recall, 3), r.median_error, r.none_frames, r.false_alarms) == (3, 0.333, 54.5, 0, 0.0)


def test_first_known_and_typed(spark):
    df = spark.createDataFrame([("a", 1, []), ("a", 2, [4]), ("a", 3, [5]), ("b", 1, None)], "k string, o int, v array<int>")
    assert {r.k: r.v for r in aggregates.first_known(df, ["k"], "v", "o").collect()} == {"a": [4], "b": None}


def test_labels_of_equal_times(spark, tmp_path):
    labels = spark.createDataFrame([("v", 5.0, k, str(k)) for k in (7, 3, 9, 1, 8)], "video string, timestamp_s double, event_id int, team string").repartition(3)
    placed = lambda path: [r.team for r in sorted(readers.read_labels(spark, path).collect(), key=lambda r: int(r.event_id))]
    writers.write_labels(labels, ["video"], str(tmp_path / "a"))
    assert placed(str(tmp_path / "a")) == ["1", "3", "7", "8", "9"]
    writers.write_labels(labels, ["video"], str(tmp_path / "b"), order=[F.col("event_id") % 4, F.col("event_id")])
    assert placed(str(tmp_path / "b")) == ["8", "1", "9", "3", "7"]


def test_many_calibrations_share_files(spark, tmp_path):
    pair = lambda x, y: F.array(F.lit(x), F.lit(y))
    square = F.array(pair(0.0, 0.0), pair(1.0, 0.0), pair(1.0, 1.0), pair(0.0, 1.0))
    none = lambda kind: F.lit(None).cast(kind)
    rows = spark.range(0, 300, 1, 3).select(
        F.concat(F.lit("v"), "id").alias("video"), F.lit("fiba_3x3").alias("court_standard"), F.array(F.lit(8), F.lit(6)).alias("image_size"), square.alias("image_points"), square.alias("court_points"),
        F.when(F.col("id") % 2 == 0, pair(1.0, 2.0)).alias("rim_center"), none("array<array<double>>").alias("rim_edge"), none("string").alias("note"), none("array<string>").alias("landmark_names"),
    )
    writers.write_calibrations(rows, str(tmp_path / "many"), lines=True)
    assert len(list((tmp_path / "many").rglob("part-*"))) == 3
    back = readers.read_calibrations(spark, str(tmp_path / "many"), lines=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select(*back.columns).collect()))
    bad = rows.limit(1).withColumn("court_points", F.slice("court_points", 1, 3))
    writers.write_calibrations(bad, str(tmp_path / "bad"), lines=True)
    with pytest.raises(Exception, match="four or more"):
        readers.read_calibrations(spark, str(tmp_path / "bad"), lines=True).collect()
