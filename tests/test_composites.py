import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions import court, pixels
from trackmill.operators import analysis, composites, models, shots
from trackmill.sources import readers

PERSON = "video string, frame int, track int, box struct<x:double,y:double,w:double,h:double>"
H = [[0.01, 0, 0], [0, 0.01, 0], [0, 0, 1]]


def person(frame, track, x, y, video="v"):
    """Feet at 100 x, 100 y."""
    return (video, frame, track, (100.0 * x - 10, 100.0 * y - 50, 20.0, 50.0))


def test_shooter_stands_at_the_free_throw_spot(spark):
    rows = [person(f, 1, 0.0, 5.9) for f in range(0, 121, 3)] + [person(f, 2, 4.0, 5.9) for f in range(0, 121, 3)] + [person(f, -1, 4.0, 5.9) for f in range(0, 121, 3)]
    persons = spark.createDataFrame(rows, PERSON)
    shots = spark.createDataFrame([("v", 0, 100), ("v", 1, 5), ("w", 0, 100)], "video string, shot int, release int")
    ball = spark.createDataFrame([("v", f, 0.0, 560.0) for f in range(0, 121, 3)] + [("v", 4, None, None)], "video string, frame int, x double, y double")
    c = court.court("fiba_3x3")
    info = {(r.video, r.shot): r for r in composites.shooter_info(shots, persons, ball, H, c).collect()}
    assert (info["v", 0].track, info["v", 0].zone, info["v", 0].frame, info["v", 0].score) == (1, "ft", 99, 0.0)
    assert info["v", 1].zone == "inside_arc"  # nothing is known of the time before
    assert (info["w", 0].track, info["w", 0].zone) == (None, None) and len(info) == 3
    crowd = persons.union(spark.createDataFrame([person(99, 3, 1.0, 5.9)], PERSON))
    assert composites.shooter_info(shots.where("video = 'v' and shot = 0"), crowd, ball, H, c).first().zone == "inside_arc"
    near = composites.near_release(shots, persons, ball)
    items = {(r.video, r.shot): r for r in composites.proposed_shooters(shots, near).collect()}
    assert items["v", 0].proposal == 1 and [k.id for k in items["v", 0].candidates] == [1, 2] and items["w", 0].candidates == []


def test_team_of_a_shot(spark):
    rows = [(*person(f, 1, 0, 5), "A" if f < 60 else "B") for f in range(0, 90, 3)] + [(*person(f, 2, 0, 5), "?") for f in range(0, 60, 3)]
    persons = spark.createDataFrame(rows, PERSON + ", label string")
    shots = spark.createDataFrame([("v", 0, 75, 1), ("v", 1, 20, 2), ("v", 2, 20, None), ("v", 3, 20, 9)], "video string, shot int, release int, track int")
    tracks = spark.createDataFrame([("v", 2, "B"), ("v", 9, "?")], "video string, track int, vote string")
    found = {r.shot: r.team for r in composites.shot_teams(shots, persons, "label", tracks).collect()}
    assert found == {0: "B", 1: "B", 2: "?", 3: "?"}  # shot 0: the views with an overlap say A and don't count


def test_numbers_and_identities(spark):
    def sure(k):
        return [float(i == k) for i in range(5)]

    shots = [("v", 0, "A", sure(0)), ("v", 1, "A", sure(1)), ("v", 2, "B", sure(2)), ("v", 3, "?", sure(2)), ("v", 4, "A", [0.2] * 5), ("v", 5, "A", None), ("w", 6, "?", sure(4))]
    crops = spark.createDataFrame(shots, "video string, shot int, team string, probs array<double>")
    numbers = {r.shot: (r.team, r.number) for r in composites.assign_numbers(crops, [4, 6, 9, 10, 11]).collect()}
    assert numbers == {0: ("A", "4"), 1: ("A", "6"), 2: ("B", "9"), 3: ("?", "9"), 4: ("A", "4"), 5: ("A", "?"), 6: ("?", "11")}
    both = {r.shot: (r.team, r.number) for r in composites.assign_numbers(crops, [4, 6, 9, 10, 11], both_teams=True).collect()}
    assert both[3] == ("B", "9") and both[6] == ("?", "11") and both[4] == both[5] == ("A", "?")
    assert composites.assign_numbers(crops.limit(0), [4]).count() == 0


def test_errors_of_shots(spark):
    schema = "video string, id long, at double, made boolean"
    gt = spark.createDataFrame([("v", 0, 10.0, True), ("v", 1, 20.0, False), ("v", 2, 30.0, True), ("v", 3, 99.5, True)], schema)
    pred = spark.createDataFrame([("v", 0, 10.4, True), ("v", 1, 19.8, True), ("v", 2, 50.0, False)], schema)
    ends = spark.createDataFrame([("v", 2997)], "video string, frames int")
    errors = composites.shot_errors(gt, pred, ends)
    assert sorted((r.kind, r.gt_id, r.pred_id) for r in errors.where("gt_id is not null and pred_id is not null").collect()) == [("right", 0, 0), ("wrong", 1, 1)]
    assert [(r.gt_id, r.pred_id) for r in errors.where("kind = 'missed'").collect()] == [(2, None)] and [r.pred_id for r in errors.where("kind = 'extra'").collect()] == [2]
    s = composites.error_summary(errors).first()
    assert (s.matched, s.recall, s.precision, s.make_accuracy) == (2, 2 / 3, 2 / 3, 0.5) and s.most == pytest.approx(0.4)


def test_features_and_model(spark):
    rows = spark.createDataFrame([(0.5, 1.0, None), (None, 1.0, 2.0), (-0.5, float("nan"), 3.0)], "dx double, vx double, vy double")
    none, f = F.lit(None).cast("double"), F.col
    features = shots.make_features(f("dx"), f("vx"), F.lit(3.0), f("vy"), none, none, none, F.lit(True), none.cast("boolean"), none)
    got = [r.f for r in rows.select(features.alias("f")).collect()]
    assert got == [[0.5, 0.0, 0.0, 1.5, 0.0, 3.0, 1.0, 0.0, 1.0], None, [0.5, 0.0, 3.0, 1.5, 0.0, 3.0, 1.0, 0.0, 1.0]]
    model = {"mean": [0] * 9, "std": [1] * 9, "w": [-4] + [0] * 8, "b": 1.0, "threshold": 0.4}
    scored = [r.m for r in rows.select(shots.made_by_model(features, model).alias("m")).collect()]
    assert [m.made for m in scored] == [False, False, False] and scored[1].confidence == 0.7 and scored[0].confidence == pytest.approx(2 * abs(1 / (1 + np.e) - 0.5))


def test_review_items(spark):
    cand = "array<struct<id:int,dist:double,n:long>>"
    items = spark.createDataFrame([("v", 0, "A", [(1, 0.1, 3), (2, 0.15, 2)]), ("v", 1, "B", [(1, 0.1, 3)]), ("v", 2, "A", [(2, 0.1, 3), (1, 0.9, 1)]), ("v", 3, "A", []), ("v", 4, "A", [(2, 0.1, 1)])], f"video string, event_id int, label_team string, candidates {cand}")
    players = spark.createDataFrame([("v", 1, "A"), ("v", 2, "B")], "video string, id int, team string")
    decisions = spark.createDataFrame([("v", 3, "ok")], "video string, event_id int, decision string")
    found = {r.event_id: (r.flag, r.label_team_ds, r.decision) for r in composites.review_items(items, players, decisions).collect()}
    # letters are swapped: two labels agree once (0), differ in 1, 2 and 4
    assert found == {0: ("team differs from shot label", "B", None), 1: (None, "A", None), 2: (None, "B", None), 3: ("no proposal", "B", "ok"), 4: (None, "B", None)}
    rows = spark.createDataFrame([("B", 4), (None, 1), ("A", None), ("A", 7)], "team string, number int")
    assert [tuple(r) for r in composites.in_button_order(rows).collect()] == [("A", 7), ("A", None), ("B", 4), (None, 1)]


def test_ball_items(spark):
    frames = spark.createDataFrame([("v", 7), ("v", 12345)], "video string, frame long")
    proposals = spark.createDataFrame([("v_f00007.jpg", [1.0])], "image string, proposals array<double>")
    labels = spark.createDataFrame([("v_f12345.jpg", "none")], "image string, label string")
    rims = spark.createDataFrame([("v", [1.0, 2.0])], "video string, rim array<double>")
    assert sorted((r.image, r.proposals, r.label) for r in composites.ball_items(frames, proposals, labels, rims).collect()) == [("v_f00007.jpg", [1.0], None), ("v_f12345.jpg", None, "none")]


def test_colours(spark):
    red, blue, grey = ([0, 0, 255], [255, 0, 0], [90, 90, 90])
    assert pixels.hsv(np.array([red, blue, [0, 255, 0], grey], np.uint8)).tolist() == [[0, 255, 255], [120, 255, 255], [60, 255, 255], [0, 0, 90]]
    image = np.array([red] * 30 + [blue] * 30 + [grey] * 40, np.uint8).reshape(10, 10, 3)
    vector, share = pixels.colour_vector(image)
    assert share == 0.6 and np.flatnonzero(vector).tolist() == [3, 51] and np.dot(vector, vector) == pytest.approx(1)
    assert pixels.colour_vector(image, 118.0)[1] == 0.3 and pixels.colour_vector(image[:1]) == (None, 1.0)
    assert pixels.court_hue(image.reshape(-1, 3)) == 60.0 and pixels.court_hue(np.array([grey] * 9, np.uint8)) is None
    boxed = pixels.letterbox(image[:5], 20)
    assert boxed.shape == (20, 20, 3) and (boxed[:5] == 114).all() and (boxed[5:15] != 114).any(2).all()
    rows = spark.createDataFrame([(bytearray(image.tobytes()), 10, 10), (None, None, None)], "image binary, h int, w int")
    got = [r.c for r in rows.select(pixels.colour_column("image", "h", "w").alias("c")).collect()]
    assert got[0].share == 0.6 and got[0].vector == pytest.approx(vector) and (got[1].vector, got[1].share) == (None, 0.0)


def test_batch_scores(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a")), (2, None), (3, bytearray(b"abc"))], "id int, image binary")
    found = {r.id: r.probs for r in models.batch_scores(rows, "image", lambda: lambda images: [[len(i), 1.0] for i in images], 2).collect()}
    assert found == {1: [1.0, 1.0], 2: None, 3: [3.0, 1.0]}


def test_keypoints_and_video_info(spark, tmp_path):
    point = lambda name, x: {"name": "p", "value": name, "point": {"x": x, "y": 2 * x}}
    line = {"projects": {"k": {"labels": [{"annotations": {"objects": [point("a", 1.5), point("b", 3.0)]}}]}}}
    (tmp_path / "k.ndjson").write_text(json.dumps(line) + "\n" + json.dumps({"projects": {}}) + "\n")
    assert [tuple(r) for r in readers.read_keypoints(spark, str(tmp_path / "k.ndjson")).collect()] == [("a", 1.5, 3.0), ("b", 3.0, 6.0)]
    (tmp_path / "i.json").write_text(json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "hevc", "width": 3840, "height": 2160, "r_frame_rate": "30000/1001"}], "format": {"duration": "10.0"}}))
    r = readers.read_video_info(spark, str(tmp_path / "i.json")).first()
    assert (r.width, r.codec, r.n_frames, r.duration_s) == (3840, "hevc", 300, 10.0) and r.fps == pytest.approx(29.97003)


def test_areas_and_torsos():
    r = np.random.default_rng(2)
    for high, wide, h, w in ((10, 7, 4, 3), (12, 12, 3, 4), (5, 9, 5, 9), (3, 2, 7, 5)):
        image = r.integers(0, 256, (high, wide, 3)).astype(np.uint8)
        fine = np.kron(image, np.ones((h, w, 1))).reshape(h, high, w, wide, 3).mean((1, 3))  # each pixel as h x w parts
        assert np.abs(pixels.area_means(image, h, w).astype(float) - fine).max() <= 0.5 + 1e-9
    frame = r.integers(0, 256, (300, 200, 3)).astype(np.uint8)
    torso = pixels.torso_image(frame, -5.0, 100.0, 60.0, 150.0)
    assert (torso == pixels.letterbox(frame[122:182, 0:55])).all()
    assert pixels.torso_image(frame, 0.0, 0.0, 7.0, 100.0) is None and pixels.torso_image(frame, 0.0, 0.0, 100.0, 10.0) is None
    assert pixels.letterbox(frame[:0]).tolist() == [[[114] * 3] * 128] * 128


def test_moving_pixels(spark):
    orange, black = [0, 128, 255], [0, 0, 0]
    pictures = {0: [orange, black, black], 1: [black, orange, black], 2: [black, orange, orange], 4: [orange, orange, black], 5: None, 6: [orange] * 3}
    rows = [("v", f, None if p is None else bytes(x for c in p for x in c), 1, 3) for f, p in pictures.items()] + [("v", 7, bytes(orange * 2), 1, 2), (None, 1, None, 1, 1)]
    df = spark.createDataFrame(rows, "video string, frame int, image binary, height int, width int")
    for piece in (1, 2, 3, 900):
        assert {r.frame: r.score for r in pixels.moving_score(df, piece=piece).collect()} == {0: 0, 1: 1, 2: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    assert {r.frame: r.score for r in pixels.moving_score(df, step=2, piece=3).collect()} == {0: 0, 1: 0, 2: 2, 4: 1, 5: 0, 6: 1, 7: 0}
    assert pixels.moving_score(df.limit(0)).count() == 0


def test_equally_near_shooters_go_by_their_track(spark):
    """Distances that differ in their last bits only are equal."""
    near = spark.createDataFrame([("v", 0, 2, 0.1 + 0.2, 4), ("v", 0, 1, 0.3 + 2e-13, 4), ("v", 0, 3, 0.3, 5)], "video string, shot int, track int, dist double, n long")
    ranks = {r.track: r["rank"] for r in composites.ranked_shooters(near).collect()}
    assert ranks == {3: 1, 1: 2, 2: 3}
