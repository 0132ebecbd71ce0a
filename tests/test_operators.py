"""Operators on small cases with known answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions import court, geometry, values
from trackmill.operators import aggregates, matching, models, sequences, spatial, tracking
from trackmill.operators.shots import detect_shots
from trackmill.sources import readers, writers
from trackmill.streaming import streams


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_points_and_zones(spark):
    for rules, zone, want in (("5v5", "inside_arc", 2), ("5v5", "beyond_arc", 3), ("5v5", "ft", 1), ("3x3", "inside_arc", 1), ("3x3", "beyond_arc", 2), ("3x3", "ft", 1)):
        assert one(spark, court.points_for(F.lit(rules), F.lit(zone), F.lit(True)))[0] == want
    assert one(spark, court.points_for(F.lit("5v5"), F.lit("ft"), F.lit(False)))[0] == 0
    with pytest.raises(Exception, match="4v4"):
        spark.range(1).select(court.points_for(F.lit("4v4"), F.lit("ft"), F.col("id") == 0)).collect()
    c = court.court("fiba_3x3")
    edge = [(0, c.hoop_y, False), (0, c.hoop_y + 6.74, False), (0, c.hoop_y + 6.76, True), (0, c.hoop_y + 6.75, False), (6.61, 0.5, True), (6.59, 0.5, False)]
    assert [one(spark, court.beyond_arc(c, F.lit(float(x)), F.lit(float(y))))[0] for x, y, _ in edge] == [w for *_, w in edge]
    assert one(spark, court.on_court(c, F.lit(0.0), F.lit(5.0)), court.on_court(c, F.lit(10.0), F.lit(5.0))) == (True, False)
    lines = {}
    for r in sorted(court.court_lines(spark, "fiba_3x3").collect()):
        lines.setdefault(r.line, []).append((r.x, r.y))
    assert len(lines) == 8 and lines["far"] == [(-7.5, 11.0), (7.5, 11.0)] and len(lines["arc"]) == 120
    assert lines["arc"][0] == pytest.approx((c.corner_x, c.arc_break_y)) and lines["arc"][-1] == pytest.approx((-c.corner_x, c.arc_break_y))
    points = court.landmarks("fiba_3x3")
    assert len(points) == 11 and points["top_right_corner"] == (7.5, 11.0) and points["arc_top"] == (0.0, c.hoop_y + c.arc_radius)


def test_homography(spark):
    a, b = [(-7.5, 0), (7.5, 0), (7.5, 11), (-7.5, 11)], [(100, 900), (1800, 950), (1200, 400), (500, 380)]
    h = geometry.solve_homography(b, a)
    assert geometry.reprojection_error(h, b, a) < 1e-6
    back = one(spark, geometry.project(np.linalg.inv(h), (p := geometry.project(h, F.lit(950.0), F.lit(700.0)))["x"], p["y"]).alias("q")).q
    assert abs(back.x - 950) < 1e-6 and abs(back.y - 700) < 1e-6
    assert geometry.rim_centre((940, 830), (980, 830), (960, 835), (960, 825)) == (960, 830)


def test_values(spark):
    r = one(spark, values.pairs_in(F.lit("1: 9, 5: 6. 6: 6, 7: 11, 5: 8")).alias("m"), values.integers_in(F.lit("Offense: 2, 6")).alias("i"), values.class_number(F.lit("b12")).alias("c"), values.percent(F.lit(0.125)).alias("p"), values.flag(F.lit(" Yes ")).alias("f"), values.circular_distance(F.lit(175), F.lit(5)).alias("d"))
    assert r.m == {1: 9, 5: 8, 6: 6, 7: 11} and r.i == [2, 6] and (r.c, r.p, r.f, r.d) == (12, "12.5%", True, 10.0)


def test_greedy_matching(spark):
    for seed in range(3):
        r = random.Random(seed)
        gt, pred = [(i % 2, i, round(r.uniform(0, 20), 1)) for i in range(30)], [(i % 2, i, round(r.uniform(0, 20), 1)) for i in range(30)]
        want, used = set(), set()
        for d, i, j, v in sorted((abs(q - p), i, j, v) for v, i, p in gt for u, j, q in pred if u == v and abs(q - p) <= 1.0):
            if ("g", i) not in used and ("p", j) not in used:
                want.add((i, j))
                used |= {("g", i), ("p", j)}
        found = matching.one_to_one(spark.createDataFrame(gt, "v int, i int, t double"), spark.createDataFrame(pred, "v int, j int, u double"), ["v"], "i", "j", "t", "u", 1.0)
        assert {(x.i, x.j) for x in found.collect()} == want


def test_evaluation(spark):
    s = "video string, event_id int, timestamp_s double, team string, zone string, made boolean, points int"
    gt = [("v", 0, 10.0, "A", "inside_arc", True, 1), ("v", 1, 20.0, "A", "inside_arc", False, 0), ("v", 2, 30.0, "B", "beyond_arc", True, 2)]
    pred = [("v", 0, 10.4, "B", "inside_arc", True, 1), ("v", 1, 20.2, "B", "inside_arc", True, 1), ("v", 2, 45.0, "A", "ft", False, 0)]
    r = matching.evaluate(spark.createDataFrame(gt, s), spark.createDataFrame(pred, s), ["video"]).first()
    assert (r.matched, round(r.recall, 3), round(r.precision, 3), r.made_accuracy, r.team_accuracy, r.swapped, r.points_error_b) == (2, 0.667, 0.667, 0.5, 1.0, True, 2)


def test_unknown_teams_do_not_count(spark):
    s = "video string, event_id int, timestamp_s double, team string, zone string, made boolean, points int"

    def result(true, guessed):
        gt, pred = ([("v", k, 10.0 * k, t, "ft", True, 1) for k, t in enumerate(ts)] for ts in (true, guessed))
        return matching.evaluate(spark.createDataFrame(gt, s), spark.createDataFrame(pred, s), ["video"]).first()

    r = result("A??", "AB?")
    assert (r.team_accuracy, r.swapped, r.points_error_a, r.points_error_b, r.points_error) == (1.0, False, 0, None, 0)
    r = result("?", "?")
    assert (r.matched, r.team_accuracy, r.points_error_a, r.points_error_b) == (1, None, None, None)
    r = result("AABB?", "BBA?B")
    assert (r.team_accuracy, r.swapped, r.points_error_a, r.points_error_b) == (0.75, True, 1, 1)


def test_votes(spark):
    df = spark.createDataFrame([("a", "A"), ("a", "A"), ("a", "B"), ("a", "?"), ("b", "A"), ("b", "B"), ("c", "?")], "k string, l string")
    assert {r.k: r.vote for r in aggregates.majority(df, ["k"], "l").collect()} == {"a": "A", "b": "?", "c": "?"}
    probs = spark.createDataFrame([("x", [0.6, 0.3, 0.1]), ("x", [0.1, 0.1, 0.8]), ("x", [0.4, 0.35, 0.25])], "k string, p array<double>")
    assert aggregates.weighted_vote(probs, ["k"], "p").first()["class"] == 2
    assert aggregates.weighted_vote(probs, ["k"], "p", F.array(F.lit(0), F.lit(1))).first()["class"] == 0
    assert aggregates.weighted_vote(probs, ["k"], "p", None, 0.99).first()["class"] is None


def test_player_order(spark):
    df = spark.createDataFrame([("A", "10", True, 1), ("A", "10", False, 0), ("A", None, True, 2), ("?", "4", False, 0)], "team string, player string, made boolean, points int")
    rows = aggregates.in_player_order(aggregates.player_table(df)).collect()
    assert [(r.team, r.player, r.attempts, r.made, r.points) for r in rows] == [("A", "10", 2, 1, 1), ("A", "?", 1, 1, 2), ("?", "4", 1, 0, 0)]


def test_clean_views(spark):
    rows = [(f, o, 100) for f, o in zip((87, 90, 100, 110, 115, 118), (0.0, 0.0, 0.5, 0.1, 0.9, 0.0))]
    df = spark.createDataFrame([("s", *r) for r in rows], "k string, f int, o double, r int")
    assert sorted(r.f for r in sequences.clean_views(df, ["k"], "f", "r", "o").collect()) == [90, 110]


@pytest.mark.parametrize("degree", [1, 2])
def test_gaps_are_filled_like_a_fit(spark, degree):
    t = np.array([1000, 1001, 1003, 1004, 1010, 1011, 1012, 1040])
    y = 3 + 2.0 * (t - 1005) - 0.4 * (t - 1005.0) ** 2 + np.sin(t)
    df = spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(t, y)], "k string, t int, y double")
    found = {r.t: r.y for r in sequences.fill_gaps(df, ["k"], "t", ["y"], 12, degree).collect()}
    assert sorted(found) == [1002, 1005, 1006, 1007, 1008, 1009]
    fit = np.polyfit(t - 1007.0, y, degree)
    assert all(abs(found[f] - np.polyval(fit, f - 1007.0)) < 1e-6 for f in range(1005, 1010))


def test_rounds_of_suppression(spark):
    df = spark.createDataFrame([("k", a, a + 5) for a in (1, 4, 6, 7, 12, 13, 30)], "k string, a int, z int")
    assert [(r.a) for r in sequences.suppress_overlaps(df, ["k"], "a", "z").orderBy("a").collect()] == [1, 7, 13, 30]
    assert [r.a for r in sequences.thin_out(df.drop("z"), ["k"], "a", 5).orderBy("a").collect()] == [1, 6, 12, 30]


def test_greedy_boxes_follow_the_order_of_truth(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    gt = spark.createDataFrame([(0, 1, (0.0, 0.0, 10.0, 10.0)), (0, 2, (1.0, 0.0, 10.0, 10.0))], f"frame int, g int, a {box}")
    found = spark.createDataFrame([(0, 7, (1.0, 0.0, 10.0, 10.0)), (0, 8, (0.0, 4.0, 10.0, 10.0))], f"frame int, f int, b {box}")
    assert {(r.g, r.f) for r in spatial.greedy_boxes(gt, found, ["frame"], "g", "a", "f", "b", 0.3).collect()} == {(1, 7), (2, 8)}


def test_parabola_is_tracked(spark):
    r = np.random.default_rng(4)
    rows, seq = [], 0
    for f in range(200):
        t = f - 100
        spots = [(1000 + 12 * t + r.normal(0, 2), 1500 - 40 * t + 0.9 * t * t + r.normal(0, 2), r.uniform(0.3, 0.9))] if 0 <= t < 60 and r.random() > 0.35 else []
        spots += [(3000.0, 400.0, 0.2)] if f % 7 == 0 else []
        for x, y, c in spots:
            rows.append(("v", seq, f, x - 17, y - 17, 34.0, 34.0, c))
            seq += 1
    df = spark.createDataFrame(rows, "video string, det_seq long, frame int, x double, y double, w double, h double, conf double")
    found = {x.frame: x for x in tracking.ball_track(df).collect()}
    inside = [f for f in found if 100 <= f < 160]
    error = [np.hypot(found[f].x - (1000 + 12 * (f - 100)), found[f].y - (1500 - 40 * (f - 100) + 0.9 * (f - 100) ** 2)) for f in inside]
    assert len(inside) > 54 and np.median(error) < 5 and max(error) < 40 and len(found) - len(inside) <= 5 and any(x.state == 2 for x in found.values())


def flight(start, x0, x1, top, floor=1500.0, ry=840.0):
    rise = [(start + k, x0 + (x1 - x0) * k / 55, ry - top + (floor - ry + top) * ((25 - k) / 25) ** 2) for k in range(26)]
    fall = [(start + 25 + k, x0 + (x1 - x0) * (25 + k) / 55, ry - top + (floor - ry + top) * (k / 30) ** 2) for k in range(1, 31)]
    return rise + fall


def test_shots(spark):
    x0 = lambda miss: 1400.0 + miss
    spots = flight(100, x0(0), 2140.0, 300) + flight(300, x0(300), 2440.0, 300) + [(f + 400, x, y + 400) for f, x, y in flight(100, 1400.0, 2140.0, 100)]
    swish = [(f, 1800.0 + (x - 1800.0) * (0.2 if f > 138 else 1.0), y) for f, x, y in spots[:56]]
    track = spark.createDataFrame([("v", f, x, y) for f, x, y in swish + spots[56:]], "video string, frame int, x double, y double")
    rims = spark.createDataFrame([("v", 1800.0, 840.0, 33.0)], "video string, rx double, ry double, rr double")
    found = detect_shots(track, rims).orderBy("release").collect()
    assert [r.release for r in found] == [100, 300] and found[1].made is False


def test_logistic_and_folds(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(80, 9))
    y = (x[:, 0] < 0).astype(int)
    assert ((models.scores(models.fit_logistic(x, y), x) > 0.5) == y).mean() > 0.9
    df = spark.createDataFrame([(f"v{i % 4}", x[i].tolist(), int(y[i])) for i in range(80)], "video string, x array<double>, y int")
    rows = models.leave_one_out(df, "video", "x", "y").collect()
    assert sum(r.n for r in rows) == 80 and sum(r.right for r in rows) > 60


def test_team_colours(spark):
    r = np.random.default_rng(1)
    rows = [(np.abs(np.eye(72)[8 if i % 2 else 40] + r.normal(0, 0.02, 72)).tolist(),) for i in range(60)]
    found = models.team_colours(spark.createDataFrame(rows, "v array<double>"), "v")
    assert int(np.argmax(found["centres"][0])) == 8 and int(np.argmax(found["centres"][1])) == 40 and found["reject"] < 1


def test_events_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("event_id,timestamp_s,frame,team,zone,made,note\n5,14.5,439,B,inside_arc,0,\n,22.0,,,ft,yes,x\n")
    events = readers.read_events(spark, str(tmp_path / "in.csv"))
    rows = events.orderBy("timestamp_s").collect()
    assert (rows[0].event_id, rows[0].made, rows[1].event_id, rows[1].frame, rows[1].team, rows[1].made, rows[1].confidence) == (5, False, 1, -1, "?", True, 1.0)
    writers.write_events(events, str(tmp_path / "out"))
    assert sorted(readers.read_events(spark, str(tmp_path / "out")).collect()) == sorted(events.collect())
    (tmp_path / "bad.csv").write_text("team,zone\nC,ft\n")
    with pytest.raises(Exception, match="unknown team"):
        readers.read_events(spark, str(tmp_path / "bad.csv")).collect()


def test_other_readers(spark, tmp_path):
    (tmp_path / "mot.txt").write_text("1,2.0,3,4,5,6,0.9\n2,3,1,1,1,1\nbad,1\n")
    assert [(r.frame, r.track_id, r.score) for r in readers.read_mot(spark, str(tmp_path / "mot.txt")).collect()] == [(1, 2, 0.9), (2, 3, 1.0)]
    lines = ['168 (Game  start),"1: 9, 2: 9, 4: 10, 5: 6. 6: 6, 7: 11","Offense: 2, 6, 7; Defense: 1, 4, 5"', 'nothing,,,', '170 (x),"1: 2","no sides","Offense: 3; Defense: 4"', '171 (y)', '172 (z),3 : 4, Offense: 8']
    (tmp_path / "flow.csv").write_text("\n".join(lines) + "\n")
    flow = readers.read_flow(spark, str(tmp_path / "flow.csv"))
    r = {x.frame: x for x in flow.collect()}
    assert (r[168].label, r[168].jersey, r[168].offense, r[168].defense) == ("Game start", {1: 9, 2: 9, 4: 10, 5: 6, 6: 6, 7: 11}, [2, 6, 7], [1, 4, 5])
    assert [(r[k].jersey, r[k].offense, r[k].defense) for k in (170, 171, 172)] == [({1: 2}, [], []), ({}, [], []), ({3: 4}, [8], [])]
    assert {x.id: x.team for x in readers.team_membership(flow.withColumn("v", F.lit(1)), ["v"]).collect()} == {2: "A", 6: "A", 7: "A", 1: "B", 4: "B", 5: "B"}
    (tmp_path / "d.json").write_text('{"10": {"status": "ok"}, "2": {"status": "none"}}')
    assert [r.key for r in readers.read_keyed_json(spark, str(tmp_path / "d.json"), "status:string").orderBy(F.col("key").cast("int")).collect()] == ["2", "10"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:00:{k:02d}", "AB"[k % 2], k % 3 == 0) for k in range(50)], "ts string, team string, made boolean").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    live = streams.live_statistics(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "team", "made", "10 seconds")
    live.writeStream.format("memory").queryName("live").outputMode("complete").start().processAllAvailable()
    assert sorted(spark.table("live").collect()) == sorted(streams.live_statistics(rows, "ts", "team", "made", "10 seconds").collect())
    for q in spark.streams.active:
        q.stop()


def test_entry_queries_have_columns(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_peaks_of_one_busy_key(spark):
    r = random.Random(5)
    rows = [(None if k % 50 == 0 else 1, r.randrange(6000), float(r.randrange(30))) for k in range(1500)]
    want = []
    for key in (None, 1):
        kept = []
        for at, score in sorted(((a, v) for u, a, v in rows if u == key and v >= 5), key=lambda x: (-x[1], x[0])):
            if all(abs(at - other) > 40 for other, _ in kept):
                kept.append((at, score))
        want += [(key, *x) for x in kept]
    found = sequences.peaks(spark.createDataFrame(rows, "user long, at long, score double"), ["user"], "at", "score", 5.0, 40)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert "collect_list" not in found._jdf.queryExecution().toString()
