"""Queries of the composite operators, over persons, shots and a ball's track that Spark derives from the driver's tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions import court, geometry, pixels, values
from trackmill.operators import analysis, composites, datasets, matching, models, persons, shots, spatial, tracking
from trackmill.operators.common import scratch, written
from trackmill.plans.registry import _E, _PAIRS, QUERIES, SQL, _P, _R, _probabilities, _read, _share, query  # noqa: F401

_FLOOR = [[0.0125, 0.0, -7.0], [0.0, 0.025, 0.0], [0.0, 0.0, 1.0]]


def _persons(spark, sf_dir):
    """Seven players at most in each third frame of a video for each supplier, placed by quantities."""
    video, frame = F.col("l_suppkey"), F.pmod("l_partkey", F.lit(200)) * 3
    rows = _read(spark, sf_dir, "lineitem").groupBy(video.alias("video"), frame.alias("frame"), F.col("l_linenumber").alias("track")).agg(F.min("l_quantity").alias("q"))
    return rows.select("video", "frame", "track", "q", geometry.box(F.col("q") * 20 + F.col("track") * 9, F.col("q") * 7 + F.col("track"), F.col("q") + 40, F.col("q") + 100).alias("box"))


def _ball(spark, sf_dir):
    return _persons(spark, sf_dir).groupBy("video", "frame").agg((F.max("q") * 20).alias("x"), (F.min("q") * 7).alias("y"))


def _by_video(rows):
    """rows dealt over all tasks by video before they are multiplied, so that what follows by video isn't shuffled again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video")


def _shots(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 15).alias("video"), F.col("o_orderkey").alias("shot"), F.pmod(F.col("o_orderkey") * 7, F.lit(600)).alias("release"))


_BASE = """p AS (SELECT *, q * 20 + track * 9 AS x, q * 7 + track AS y, q + 40 AS w, q + 100 AS h FROM (SELECT l_suppkey AS video, (l_partkey % 200) * 3 AS frame, l_linenumber AS track, min(l_quantity) AS q FROM lineitem GROUP BY ALL)),
f AS (SELECT video, frame, track, q, 0.0125 * (x + w / 2) - 7.0 AS fx, 0.025 * (y + h) AS fy FROM p),
b AS (SELECT video, frame, max(q) * 20 AS bx, min(q) * 7 AS bv FROM p GROUP BY ALL),
s AS (SELECT o_custkey // 15 AS video, o_orderkey AS shot, (o_orderkey * 7) % 600 AS release FROM orders),
near AS (SELECT s.video, s.shot, p.track, median(sqrt(greatest(0, abs(bx - (x + w / 2)) - w / 2) ** 2 + (greatest(0, bv - (y + 0.45 * h)) + greatest(0, (y - 0.4 * h) - bv)) ** 2) / h) AS dist, count(*) AS n
FROM s JOIN b ON b.video = s.video AND b.frame BETWEEN release - release % 3 AND release + 9 JOIN p ON p.video = b.video AND p.frame = b.frame GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video, shot ORDER BY round(dist, 9), n DESC, track) AS rank FROM near),
best AS (SELECT s.video, s.shot, s.release, r.track, r.dist FROM s LEFT JOIN ranked r ON r.video = s.video AND r.shot = s.shot AND rank = 1)"""


def _near(spark, sf_dir):
    near = composites.near_release(_shots(spark, sf_dir), _persons(spark, sf_dir), _ball(spark, sf_dir))
    return near.withColumn("dist", F.round("dist", 9))


@query(f"WITH {_BASE} SELECT video, shot, track, round(dist, 6) AS dist, n, CAST(rank AS INTEGER) AS rank FROM ranked")
def t1_ranked_shooters(spark, sf_dir):
    exact = composites.near_release(_shots(spark, sf_dir), _persons(spark, sf_dir), _ball(spark, sf_dir)).withColumn("exact", F.col("dist"))
    return composites.ranked_shooters(exact.withColumn("dist", F.round("dist", 9))).withColumn("dist", _R("exact", 6)).drop("exact")


_CALM = """now AS (SELECT video, shot, release, track, fx AS x0, fy AS y0 FROM (SELECT best.video, shot, release, best.track, fx, fy, row_number() OVER (PARTITION BY best.video, shot ORDER BY abs(f.frame - release), f.frame) AS k FROM best JOIN f ON f.video = best.video AND f.track = best.track AND abs(f.frame - release) <= 3) WHERE k = 1),
back AS (SELECT video, shot, track, release - unnest([15, 30, 45, 60]) AS then_at FROM now),
was AS (SELECT video, shot, fx, fy FROM (SELECT back.video, shot, fx, fy, row_number() OVER (PARTITION BY back.video, shot, then_at ORDER BY abs(f.frame - then_at), f.frame) AS k FROM back JOIN f ON f.video = back.video AND f.track = back.track AND abs(f.frame - then_at) <= 3) WHERE k = 1),
moved AS (SELECT was.video, was.shot, max(sqrt((fx - x0) ** 2 + (fy - y0) ** 2)) AS moved FROM was JOIN now ON now.video = was.video AND now.shot = was.shot GROUP BY ALL),
gap AS (SELECT now.video, now.shot, min(sqrt((fx - x0) ** 2 + (fy - y0) ** 2)) AS gap FROM now JOIN f ON f.video = now.video AND f.track <> now.track AND abs(f.frame - release) <= 1 AND abs(fx) <= 7.8 AND fy BETWEEN -0.3 AND 11.3 GROUP BY ALL),
calm AS (SELECT now.video, now.shot, moved, gap, coalesce(moved <= 3.0, false) AND coalesce(gap >= 0.8, true) AS still FROM now LEFT JOIN moved USING (video, shot) LEFT JOIN gap USING (video, shot))"""


@query(f"WITH {_BASE}, {_CALM} SELECT video, shot, round(moved, 6) AS moved, round(gap, 6) AS gap, still FROM calm")
def w9_free_throw_context(spark, sf_dir):
    calm = composites.free_throw_context(_shots(spark, sf_dir), _persons(spark, sf_dir), _FLOOR, court.court("fiba_3x3"), most_moved=3.0, least_gap=0.8, track=_ball(spark, sf_dir))
    return calm.withColumns({"moved": _R("moved", 6), "gap": _R("gap", 6)})


@query(f"""WITH {_BASE}, {_CALM.replace("moved <= 3.0", "moved <= 0.4").replace("gap >= 0.8", "gap >= 2.5")},
spot AS (SELECT * FROM (SELECT best.video, shot, f.frame, fx, fy, row_number() OVER (PARTITION BY best.video, shot ORDER BY abs(f.frame - release), f.frame) AS k FROM best JOIN f ON f.video = best.video AND f.track = best.track AND abs(f.frame - release) <= 12) WHERE k = 1),
v AS (SELECT 1.575 + sqrt(6.75 * 6.75 - 6.60 * 6.60) AS cut)
SELECT best.video, best.shot, release, best.track, round(dist, 6) AS score, spot.frame, round(fx, 6) AS court_x, round(fy, 6) AS court_y,
CASE WHEN fx IS NULL THEN NULL WHEN coalesce(still, false) AND abs(fx) <= 1.47 AND fy BETWEEN 5.6 AND 6.4 THEN 'ft' WHEN (fy <= cut AND abs(fx) <= 6.60) OR (fy > cut AND sqrt(fx * fx + (fy - 1.575) * (fy - 1.575)) <= 6.75) THEN 'inside_arc' ELSE 'beyond_arc' END AS zone
FROM best CROSS JOIN v LEFT JOIN spot USING (video, shot) LEFT JOIN calm USING (video, shot)""")
def z2_shooter_info(spark, sf_dir):
    info = composites.shooter_info(_shots(spark, sf_dir), _persons(spark, sf_dir), _ball(spark, sf_dir), _FLOOR, court.court("fiba_3x3"))
    return info.withColumns({"score": _R("score", 6), "court_x": _R("court_x", 6), "court_y": _R("court_y", 6)})


def _team():
    return F.when(F.col("q") < 6, "A").when(F.col("q") < 14, "B").otherwise("?")


_TRACKS = """looks AS (SELECT k.video, f.track, CASE WHEN q < 6 THEN 'A' WHEN q < 14 THEN 'B' ELSE '?' END AS label FROM (SELECT DISTINCT video, release FROM s) k JOIN f ON f.video = k.video AND f.frame = k.release - k.release % 3 WHERE abs(fx) <= 7.8 AND fy BETWEEN -0.3 AND 11.3),
tracks AS (SELECT video, track, count(*) FILTER (label <> '?') AS known, CASE WHEN count(*) FILTER (label = 'A') >= 0.6 * count(*) FILTER (label <> '?') AND count(*) FILTER (label = 'A') > 0 THEN 'A' WHEN count(*) FILTER (label = 'B') >= 0.6 * count(*) FILTER (label <> '?') AND count(*) FILTER (label = 'B') > 0 THEN 'B' ELSE '?' END AS vote FROM looks GROUP BY ALL)"""


def _track_teams(spark, sf_dir):
    keyframes = _shots(spark, sf_dir).select("video", F.col("release").alias("frame")).distinct()
    return composites.track_teams(_persons(spark, sf_dir), keyframes, _FLOOR, court.court("fiba_3x3"), _team())


@query(f"WITH {_BASE}, {_TRACKS} SELECT * FROM tracks")
def z4_track_teams(spark, sf_dir):
    return _track_teams(spark, sf_dir)


@query(f"""WITH {_BASE}, {_TRACKS},
o AS (SELECT a.video, a.frame, a.track, coalesce(max(CASE WHEN c.track IS NOT NULL THEN greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) / greatest(a.w * a.h, 1) END), 0) AS overlap FROM p a LEFT JOIN p c ON a.video = c.video AND a.frame = c.frame AND a.track <> c.track GROUP BY ALL),
view AS (SELECT best.video, shot, overlap <= 0.15 AS clean, CASE WHEN q < 6 THEN 'A' WHEN q < 14 THEN 'B' ELSE '?' END AS label FROM best JOIN p ON p.video = best.video AND p.track = best.track AND p.frame BETWEEN release - 45 AND release + 15 JOIN o ON o.video = p.video AND o.frame = p.frame AND o.track = p.track),
used AS (SELECT * FROM (SELECT *, max(CAST(clean AND label <> '?' AS INTEGER)) OVER (PARTITION BY video, shot) AS sure FROM view) WHERE sure = 0 OR clean),
voted AS (SELECT video, shot, CASE WHEN a > 0 AND a >= 0.6 * n THEN 'A' WHEN z > 0 AND z >= 0.6 * n THEN 'B' END AS v FROM (SELECT video, shot, count(*) FILTER (label = 'A') AS a, count(*) FILTER (label = 'B') AS z, count(*) FILTER (label <> '?') AS n FROM used GROUP BY ALL))
SELECT best.video, best.shot, coalesce(v, vote, '?') AS team FROM best LEFT JOIN voted USING (video, shot) LEFT JOIN tracks ON tracks.video = best.video AND tracks.track = best.track""")
def z3_shot_teams(spark, sf_dir):
    people = written(_persons(spark, sf_dir).withColumn("label", _team()), f"{scratch(spark)}/persons")  # five steps read them
    ball = people.groupBy("video", "frame").agg((F.max("q") * 20).alias("x"), (F.min("q") * 7).alias("y"))
    near = composites.near_release(_shots(spark, sf_dir), people, ball).withColumn("dist", F.round("dist", 9))
    best = composites.ranked_shooters(near).where("rank = 1").select("video", "shot", "track")
    keyframes = _shots(spark, sf_dir).select("video", F.col("release").alias("frame")).distinct()
    tracks = composites.track_teams(people, keyframes, _FLOOR, court.court("fiba_3x3"), F.col("label"))
    return composites.shot_teams(_shots(spark, sf_dir).join(best, ["video", "shot"], "left"), people, "label", tracks)


@query(f"""WITH {_BASE} SELECT s.video, s.shot, p.track, count(DISTINCT p.frame) AS frames FROM s JOIN b ON b.video = s.video AND b.frame BETWEEN (release - 12) - (release - 12) % 3 AND release JOIN p ON p.video = b.video AND p.frame = b.frame AND bx BETWEEN x - 0.1 * w AND x + 1.1 * w AND bv BETWEEN y - 0.1 * h AND y + 0.8 * h GROUP BY ALL""")
def j4_possession(spark, sf_dir):
    seen = matching.in_window(_shots(spark, sf_dir), _ball(spark, sf_dir), ["video"], "release", "frame", 14, 0).where(F.col("frame") >= F.col("release") - 12 - F.pmod(F.col("release") - 12, F.lit(3)))
    persons = _persons(spark, sf_dir).select("video", "frame", "track", "box")
    boxes = seen.select("video", "shot", "frame").join(persons, ["video", "frame"])
    return spatial.possession(seen.select("video", "shot", "frame", "x", "y"), boxes, ["video", "shot", "frame"], "track", "box", F.col("x"), F.col("y"))


@query(f"WITH {_BASE} SELECT s.video, s.shot, coalesce(p.track, -1) AS track, coalesce(p.q, -1) AS q FROM s LEFT JOIN p ON p.video = s.video AND p.frame = s.release - s.release % 3")
def j6_floor_aligned(spark, sf_dir):
    found = matching.floor_aligned(_shots(spark, sf_dir), _persons(spark, sf_dir).select("video", "frame", "track", "q").withColumnRenamed("frame", "release"), ["video"], "release", 3)
    return found.select("video", "shot", F.coalesce("track", F.lit(-1)).alias("track"), F.coalesce("q", F.lit(-1.0)).alias("q"))


def _crops(spark, sf_dir):
    shot = F.floor(F.col("vec_id") / 7).cast("long")
    return _probabilities(spark, sf_dir).select((shot % 3).alias("video"), shot.alias("shot"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("?")), (F.floor(shot / 3) % 3 + 1).cast("int")).alias("team"), "vec_id", "label", "probs")


_CROPS = f"c AS (SELECT (vec_id // 7) % 3 AS video, vec_id // 7 AS shot, ['A', 'B', '?'][(vec_id // 21) % 3 + 1] AS team, vec_id, label, probs FROM ({_P})), r AS (SELECT video, team, class FROM (SELECT *, row_number() OVER (PARTITION BY video, team ORDER BY mass DESC, class) AS k FROM (SELECT video, team, class, sum(v) AS mass FROM (SELECT video, team, unnest(probs) AS v, unnest(range(0, 10)) AS class FROM c WHERE team <> '?' AND list_max(probs) >= 0.3) GROUP BY ALL)) WHERE k <= 3 AND mass > 0)"
_VOTE = "k AS (SELECT video, shot, class, q / greatest(sum(q) OVER (PARTITION BY vec_id), 1e-9) AS v, max(q) OVER (PARTITION BY vec_id) / greatest(sum(q) OVER (PARTITION BY vec_id), 1e-9) AS top FROM e), m AS (SELECT video, shot, class, sum(v) AS v FROM k WHERE top >= 0.3 GROUP BY ALL), w AS (SELECT video, shot, arg_max(class, (v, -class)) AS class FROM m GROUP BY ALL)"


@query(f"""WITH {_CROPS}, a AS (SELECT video, team, list(class) AS allowed FROM r GROUP BY ALL), e AS (SELECT video, shot, vec_id, class, CASE WHEN list_contains(coalesce(allowed, range(0, 10)), class) THEN q ELSE 0 END AS q FROM (SELECT c.video, shot, vec_id, allowed, unnest(probs) AS q, unnest(range(0, 10)) AS class FROM c LEFT JOIN a ON a.video = c.video AND a.team = c.team)),
{_VOTE} SELECT d.video, d.shot, d.team, coalesce(CAST(class + 4 AS VARCHAR), '?') AS number FROM (SELECT DISTINCT video, shot, team FROM c) d LEFT JOIN w USING (video, shot)""")
def z5_assign_numbers(spark, sf_dir):
    return composites.assign_numbers(_crops(spark, sf_dir), list(range(4, 14)), least=0.3)


@query(f"""WITH {_CROPS}, a AS (SELECT video, list(DISTINCT class) AS allowed FROM r GROUP BY ALL), e AS (SELECT video, shot, vec_id, class, CASE WHEN list_contains(coalesce(allowed, range(0, 10)), class) THEN q ELSE 0 END AS q FROM (SELECT c.video, shot, vec_id, allowed, unnest(probs) AS q, unnest(range(0, 10)) AS class FROM c LEFT JOIN a ON a.video = c.video)),
{_VOTE}, one AS (SELECT video, class, min(team) AS owner FROM r GROUP BY ALL HAVING count(DISTINCT team) = 1)
SELECT d.video, d.shot, coalesce(owner, d.team) AS team, coalesce(CAST(w.class + 4 AS VARCHAR), '?') AS number FROM (SELECT DISTINCT video, shot, team FROM c) d LEFT JOIN w USING (video, shot) LEFT JOIN one ON one.video = d.video AND one.class = w.class""")
def z6_assign_identities(spark, sf_dir):
    return composites.assign_numbers(_crops(spark, sf_dir), list(range(4, 14)), both_teams=True, least=0.3)


@query(f"""WITH {_CROPS}, g AS (SELECT span.b AS before, span.a AS after, o.overlap, l.level FROM (SELECT unnest([{{'b': 12, 'a': 15}}, {{'b': 0, 'a': 12}}, {{'b': 6, 'a': 6}}]) AS span) spans, (SELECT unnest([0.05, 0.3]) AS overlap) o, (SELECT unnest([0.2, 0.3]) AS level) l),
n AS (SELECT g.*, video, shot, probs, (vec_id % 5) / 10 <= g.overlap AS clean FROM g, c WHERE vec_id % 7 * 5 - 12 BETWEEN -before AND after),
u AS (SELECT * FROM (SELECT *, max(CAST(clean AS INTEGER)) OVER (PARTITION BY before, after, overlap, level, video, shot) AS some_clean FROM n) WHERE some_clean = 0 OR clean),
m AS (SELECT before, after, overlap, level, shot, class, sum(v) AS v FROM (SELECT before, after, overlap, level, shot, unnest(probs) AS v, unnest(range(0, 10)) AS class FROM u WHERE list_max(probs) >= level) GROUP BY ALL),
w AS (SELECT before, after, overlap, level, shot, arg_max(class, (v, -class)) AS guess FROM m GROUP BY ALL), t AS (SELECT shot, min(label) AS want FROM c GROUP BY ALL)
SELECT g.before, g.after, CAST(g.overlap AS DOUBLE) AS overlap, CAST(g.level AS DOUBLE) AS level, count(*) AS n, count(*) FILTER (guess = want) AS "right" FROM g CROSS JOIN t LEFT JOIN w ON w.shot = t.shot AND w.before = g.before AND w.after = g.after AND w.overlap = g.overlap AND w.level = g.level GROUP BY ALL""")
def m5_identity_grid(spark, sf_dir):
    crops = _crops(spark, sf_dir)
    truth = crops.groupBy("video", "shot").agg(F.min("label").alias("class"))
    rows = crops.select("video", "shot", F.lit(100).alias("release"), (F.col("vec_id") % 7 * 5 + 88).alias("frame"), (F.col("vec_id") % 5 / 10).alias("overlap"), "probs")
    return composites.identity_grid(rows, truth, [(12, 15), (0, 12), (6, 6)], [0.05, 0.3], [0.2, 0.3])


@query("""SELECT o_custkey % 10 AS video, o_orderkey AS event_id, o_orderkey AS shot, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 4 END AS want, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS got,
CASE WHEN o_orderkey % 5 = 0 THEN 'no label' WHEN o_orderkey % 7 = 0 THEN 'no shooter' WHEN o_orderkey % 3 = 0 THEN 'box not matched' WHEN o_orderkey % 4 = o_custkey % 4 THEN 'correct' ELSE 'wrong player' END AS result FROM orders""")
def z11_shooter_results(spark, sf_dir):
    key = F.col("o_orderkey")
    o = _read(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(10)).alias("video"), key.alias("event_id"), key.alias("shot"), (F.col("o_custkey") % 4).alias("track"), F.when(key % 5 > 0, "ok").otherwise("none").alias("status"), (key % 4).alias("gid"))
    return composites.shooter_results(o.select("video", "event_id", "shot"), o.where("event_id % 11 <> 0 OR status = 'ok'"), o.where("shot % 7 <> 0"), o.where("shot % 3 > 0"))


@query("""WITH d AS (SELECT o_custkey % 10 AS video, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS t, CASE WHEN o_totalprice < 50000 THEN '?' WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END AS g FROM orders),
c AS (SELECT video, count(*) AS n, count(*) FILTER (t = g) AS a, count(*) FILTER (g <> '?' AND t <> g) AS z, count(*) FILTER (g = '?') AS unknown FROM d GROUP BY ALL) SELECT video, n, greatest(a, z) AS "right", unknown, z > a AS swapped FROM c""")
def z12_team_results(spark, sf_dir):
    guess = F.when(F.col("o_totalprice") < 50000, "?").when(F.col("o_orderstatus") == "F", "A").otherwise("B")
    return composites.team_results(_read(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("video"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B").alias("truth"), guess.alias("guess")))


@query(f"""WITH RECURSIVE ends AS (SELECT user_id, max(us / 1e6) * 29.97 AS frames FROM ({_E}) GROUP BY 1),
{_PAIRS.replace("g.event_type = 'click'", "g.event_type = 'click' AND g.at * 29.97 < (SELECT frames FROM ends WHERE ends.user_id = g.user_id) - 45")}
SELECT m.user_id AS video, CASE WHEN (a.value > 30) = (b.value > 30) THEN 'right' ELSE 'wrong' END AS kind, i AS gt_id, j AS pred_id, b.at - a.at AS "offset" FROM m JOIN t a ON a.event_id = i JOIN t b ON b.event_id = j
UNION ALL SELECT t.user_id, 'missed', event_id, NULL, NULL FROM t JOIN ends ON ends.user_id = t.user_id WHERE event_type = 'click' AND t.at * 29.97 < frames - 45 AND event_id NOT IN (SELECT i FROM m)
UNION ALL SELECT user_id, 'extra', NULL, event_id, NULL FROM t WHERE event_type = 'purchase' AND event_id NOT IN (SELECT j FROM m)""")
def z14_shot_errors(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("id"), seconds.alias("at"), (F.col("value") > 30).alias("made"), "event_type")
    ends = rows.groupBy("video").agg((F.max("at") * 29.97).alias("frames"))
    return composites.shot_errors(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"), ends, 3600.0)


@query(f"""WITH {_BASE}, i AS (SELECT s.video, s.shot AS event_id, CASE s.shot % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '?' END AS label_team, r.track, round(r.dist, 9) AS d, round(t.dist, 9) AS d2, CASE WHEN r.track % 2 = 0 THEN 'A' WHEN r.track < 7 THEN 'B' END AS team FROM s LEFT JOIN ranked r ON r.video = s.video AND r.shot = s.shot AND r.rank = 1 LEFT JOIN ranked t ON t.video = s.video AND t.shot = s.shot AND t.rank = 2),
m AS (SELECT video, count(*) FILTER (label_team <> team) > count(*) FILTER (label_team = team) AS swapped FROM i WHERE label_team <> '?' AND team IS NOT NULL GROUP BY ALL),
n AS (SELECT i.*, CASE WHEN label_team = '?' THEN NULL WHEN coalesce(swapped, false) THEN CASE label_team WHEN 'A' THEN 'B' ELSE 'A' END ELSE label_team END AS ds FROM i LEFT JOIN m USING (video))
SELECT video, event_id, label_team, ds AS label_team_ds, CASE WHEN track IS NULL THEN 'no proposal' WHEN ds <> team THEN 'team differs from shot label' WHEN d2 - d < 0.1 THEN 'close second candidate' END AS flag, CASE WHEN event_id % 5 = 0 THEN 'keep' END AS decision FROM n""")
def z9_review_items(spark, sf_dir):
    persons = _persons(spark, sf_dir)
    label = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("?")), (F.col("shot") % 3 + 1).cast("int"))
    items = composites.proposed_shooters(_shots(spark, sf_dir), _near(spark, sf_dir)).select("video", F.col("shot").alias("event_id"), label.alias("label_team"), "candidates")
    players = persons.select("video", F.col("track").alias("id")).distinct().select("video", "id", F.when(F.col("id") % 2 == 0, "A").when(F.col("id") < 7, "B").alias("team"))
    decisions = items.where("event_id % 5 = 0").select("video", "event_id", F.lit("keep").alias("decision"))
    return composites.review_items(items, players, decisions).select("video", "event_id", "label_team", "label_team_ds", "flag", "decision")


@query("""SELECT l_orderkey, l_linenumber, round(list_sum(f), 6) AS total, round(f[4], 6) AS kept FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE [abs(l_discount * 20 - 1), coalesce(v, 0), l_quantity, least(2, abs(l_tax * 40) / greatest(2, abs(l_discount * 40))), -l_quantity * 2, 3.0, CAST(l_returnflag = 'R' AS DOUBLE), CAST(l_linestatus = 'O' AS DOUBLE), 1.0] END AS f
FROM (SELECT *, CASE WHEN l_linenumber > 1 THEN l_tax * 100 - l_quantity END AS v FROM lineitem))""")
def h20_make_features(spark, sf_dir):
    c = F.col
    none = F.lit(None).cast("double")
    f = shots.make_features(F.when(c("l_linenumber") != 7, c("l_discount") * 20 - 1), c("l_discount") * 40, c("l_tax") * 40, c("l_quantity"), F.when(c("l_linenumber") > 1, c("l_tax") * 100), -c("l_quantity") * 2, F.lit(float("inf")), c("l_returnflag") == "R", c("l_linestatus") == "O", none)
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", f.alias("f"))
    return rows.select("l_orderkey", "l_linenumber", _R(F.aggregate("f", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), _R(F.get("f", F.lit(3)), 6).alias("kept"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity * 30 AS x, l_quantity * 17 AS y, CAST(greatest(0, least(floor(l_quantity * 30 + 20 - 320), 1920 - 640)) AS INTEGER) AS a, CAST(greatest(0, least(floor(l_quantity * 17 + 20 - 320), 1080 - 640)) AS INTEGER) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a AS "left", b AS top, round((greatest(x - a, 0) + least(x + 40 - a, 640)) / 2 / 640, 6) AS cx, round((least(y + 40 - b, 640) - greatest(y - b, 0)) / 640, 6) AS h FROM o""")
def h12_crop_boxes(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.box(F.col("l_quantity") * 30, F.col("l_quantity") * 17, F.lit(40), F.lit(40)).alias("b"))
    rows = rows.withColumn("left", geometry.crop_origin(F.col("b.x") + 20, 640, 1920)).withColumn("top", geometry.crop_origin(F.col("b.y") + 20, 640, 1080))
    inside = geometry.clipped_box(F.col("b"), F.col("left"), F.col("top"), 640, 640)
    return rows.select("l_orderkey", "l_linenumber", "left", "top", _R(inside["cx"], 6).alias("cx"), _R(inside["h"], 6).alias("h"))


_FLIGHTS = """o AS (SELECT o_orderkey AS video, o_custkey % 41 AS skew, o_orderkey % 7 AS lift, CAST(o_totalprice * 100 AS BIGINT) % 90 AS drift FROM orders),
t AS (SELECT video, CAST(k AS INTEGER) AS frame, 1400.0 + (drift + 330) * k / 30.0 + CASE WHEN k > 46 THEN (skew - 60) * (k - 46) / 5.0 ELSE 0 END AS x,
CASE WHEN k <= 25 THEN 440.0 + lift * 70 + (1060 - lift * 70) * (25 - k) * (25 - k) / 625.0 ELSE 440.0 + lift * 70 + 1060 * (k - 25) * (k - 25) / 900.0 END AS y FROM o, unnest(range(0, 61)) AS u(k) WHERE (video + k) % 11 <> 3)"""


def _flights(spark, sf_dir):
    """A ball thrown for each order: how high, how far and how it drifts after the rim come from the order's numbers."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), F.pmod("o_custkey", F.lit(41)).alias("skew"), F.pmod("o_orderkey", F.lit(7)).alias("lift"), F.pmod((F.col("o_totalprice") * 100).cast("decimal(20,0)").cast("long"), F.lit(90)).alias("drift"))
    k, lift = F.col("frame"), F.col("lift") * 70
    rows = _by_video(o).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(60)))).where((F.col("video") + k) % 11 != 3)
    x = 1400.0 + (F.col("drift") + 330) * k / 30.0 + F.when(k > 46, (F.col("skew") - 60) * (k - 46) / 5.0).otherwise(0)
    y = F.when(k <= 25, 440.0 + lift + (1060 - lift) * (25 - k) * (25 - k) / 625.0).otherwise(440.0 + lift + 1060 * (k - 25) * (k - 25) / 900.0)
    return rows.select("video", "frame", x.alias("x"), y.alias("y"))


@query(f"""WITH {_FLIGHTS},
st AS (SELECT *, lag(frame) OVER w AS f0, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM t WINDOW w AS (PARTITION BY video ORDER BY frame)),
ru AS (SELECT *, sum(CASE WHEN frame - f0 <= 4 AND y0 - y > 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY frame) AS run FROM st),
fl AS (SELECT video, min(frame) AS release, max(frame) AS apex, min(y) AS top FROM ru GROUP BY video, run HAVING count(*) > 1 AND max(frame) - min(frame) >= 3 AND max(y) - min(y) >= 150 AND max(y) - 840 >= 82.5 AND 840 - min(y) >= 10),
fa AS (SELECT fl.video, release, apex, top, st.frame, st.x, st.y, CASE WHEN st.frame > apex THEN x0 END AS x0, CASE WHEN st.frame > apex THEN y0 END AS y0 FROM fl JOIN st ON st.video = fl.video AND st.frame BETWEEN apex AND apex + 44),
cr AS (SELECT video, release, apex, top, min(frame) FILTER (y0 < 840 AND 840 <= y) AS crossed, arg_min(x0 + (840 - y0) / (y - y0) * (x - x0) - 1800, frame) FILTER (y0 < 840 AND 840 <= y) AS dx FROM fa
GROUP BY ALL HAVING bool_or((abs(x - 1800) <= 132 AND abs(y - 840) <= 99) OR (frame = apex AND abs(x - 1800) <= 297))),
se AS (SELECT cr.video, release, bool_or(g BETWEEN 0 AND 14 AND y - 840 >= 82.5) AS deep, bool_or(g BETWEEN 0 AND 14 AND y - 840 >= 82.5 AND abs(x - 1800) <= 52.8) AS under, bool_or(g BETWEEN 0 AND 14 AND 840 - y >= 16.5) AS bounce,
(arg_max(x, g) FILTER (g <= 0) - arg_min(x, g) FILTER (g <= 0)) / nullif(max(g) FILTER (g <= 0) - min(g) FILTER (g <= 0), 0) AS vin, (arg_max(x, g) FILTER (g BETWEEN 3 AND 12) - arg_min(x, g) FILTER (g BETWEEN 3 AND 12)) / nullif(max(g) FILTER (g BETWEEN 3 AND 12) - min(g) FILTER (g BETWEEN 3 AND 12), 0) AS vout,
max((y - 840) / 33.0) FILTER (g BETWEEN 0 AND 14) AS depth FROM (SELECT cr.*, t.x, t.y, t.frame - crossed AS g FROM cr JOIN t ON t.video = cr.video AND t.frame BETWEEN crossed - 6 AND crossed + 14) cr GROUP BY ALL)
SELECT cr.video, cr.release, cr.apex, crossed AS "cross", round(dx, 4) AS dx, coalesce(crossed IS NOT NULL AND abs(dx) / 33 <= 0.85 AND deep AND (under OR coalesce(abs(vin) > 4 AND abs(vout) <= 0.5 * abs(vin), false)) AND NOT bounce, false) AS made,
CASE WHEN crossed IS NOT NULL THEN round(least(2.0, abs(coalesce(vout, 0)) / greatest(2.0, abs(coalesce(vin, 0)))), 4) END AS kept, CASE WHEN crossed IS NOT NULL THEN round(coalesce(depth, 3.0), 4) END AS depth FROM cr LEFT JOIN se USING (video, release)""")
def z1_detect_shots(spark, sf_dir):
    rims = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), F.lit(1800.0).alias("rx"), F.lit(840.0).alias("ry"), F.lit(33.0).alias("rr"))
    found = shots.detect_shots(_flights(spark, sf_dir), rims)
    return found.select("video", "release", "apex", "cross", _R("dx", 4).alias("dx"), "made", _R(F.get("features", F.lit(3)), 4).alias("kept"), _R(F.get("features", F.lit(5)), 4).alias("depth"))


_CHOICE = {"mean": [0.8, 4.0], "std": [0.5, 1.0], "w": [-2.0, 0.5]}


@query(f"""WITH {_BASE}, u AS (SELECT video, shot, track, (dist - 0.8) / 0.5 * -2.0 + (n - 4.0) * 0.5 AS u FROM near), e AS (SELECT *, exp(u - max(u) OVER (PARTITION BY video, shot)) AS e FROM u)
SELECT video, shot, track, round(e / sum(e) OVER (PARTITION BY video, shot), 5) AS p, row_number() OVER (PARTITION BY video, shot ORDER BY round(u, 9) DESC, track) AS rank FROM e""")
def m4_choice_rank(spark, sf_dir):
    near = composites.near_release(_shots(spark, sf_dir), _persons(spark, sf_dir), _ball(spark, sf_dir))
    found = models.ranked_by_choice(near, ["video", "shot"], "track", [F.col("dist"), F.col("n")], _CHOICE)
    return found.select("video", "shot", "track", _R("p", 5).alias("p"), F.col("rank").cast("long").alias("rank"))


_TALL = "SELECT *, x + 0 AS tx, y + 0.15 * h AS ty, w AS tw, 0.4 * h AS th FROM p WHERE frame % 6 = 0"


@query(f"""WITH {_BASE}, q6 AS ({_TALL}), g AS (SELECT q6.*, unnest(range(0, 256)) AS k FROM q6),
hid AS (SELECT g.video, g.frame, g.track, count(DISTINCT g.k) / 256.0 AS occl FROM g JOIN q6 o ON o.video = g.video AND o.frame = g.frame AND o.track <> g.track AND g.tx + (k % 16 + 0.5) / 16 * g.tw BETWEEN o.x AND o.x + o.w AND g.ty + (k // 16 + 0.5) / 16 * g.th BETWEEN o.y AND o.y + o.h GROUP BY ALL)
SELECT format('{{}}_f{{:06d}}_t{{}}.jpg', q6.video, q6.frame, q6.track) AS file, q6.frame, CASE WHEN q6.track % 2 = 0 THEN 'A' ELSE '' END AS team, q6.track * 3 AS number, round(coalesce(occl, 0), 3) AS occl, CAST(w AS INTEGER) AS box_w, CAST(h AS INTEGER) AS box_h FROM q6 LEFT JOIN hid USING (video, frame, track) WHERE q6.track < 7 AND h >= 120""")
def b11_crop_index(spark, sf_dir):
    persons = _persons(spark, sf_dir)
    players = persons.select("video", "track").distinct().select("video", "track", F.when(F.col("track") % 2 == 0, "A").alias("team"), F.when(F.col("track") < 7, F.col("track") * 3).alias("number"))
    return datasets.crop_index(persons, players, every=6, least=120).drop("video", "track")


@query(f"WITH {_BASE} SELECT video, shot, CAST(rank - 1 AS INTEGER) AS place, track, round(round(dist, 9), 6) AS dist, n FROM ranked WHERE rank <= 5")
def t3_top_candidates(spark, sf_dir):
    lists = composites.proposed_shooters(_shots(spark, sf_dir), _near(spark, sf_dir))
    return lists.select("video", "shot", F.posexplode("candidates").alias("place", "c")).select("video", "shot", "place", F.col("c.id").alias("track"), _R("c.dist", 6).alias("dist"), F.col("c.n").alias("n"))


@query(f"""WITH {_BASE}, a AS (SELECT video, shot, release, unnest(range(release - 12 - (release - 12) % 3 - CASE WHEN release < 12 AND (release - 12) % 3 <> 0 THEN 3 ELSE 0 END, release + 1, 3)) AS frame FROM s),
held AS (SELECT a.video, a.shot, p.track, count(*) AS held FROM a JOIN b ON b.video = a.video AND b.frame = a.frame JOIN p ON p.video = a.video AND p.frame = a.frame WHERE bx BETWEEN x - 0.1 * w AND x + 1.1 * w AND bv BETWEEN y - 0.1 * h AND y + 0.8 * h GROUP BY ALL),
u AS (SELECT video, shot, track, coalesce(held, 0) AS held, round(dist, 9) AS dist, n FROM near FULL JOIN held USING (video, shot, track))
SELECT video, shot, track, held, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY video, shot ORDER BY held DESC, dist NULLS LAST, n DESC NULLS LAST, track) AS INTEGER) AS rank FROM u""")
def t1_by_possession(spark, sf_dir):
    held = composites.held_before(_shots(spark, sf_dir), _persons(spark, sf_dir), _ball(spark, sf_dir))
    return composites.ranked_shooters(_near(spark, sf_dir), held).select("video", "shot", "track", "held", _R("dist", 6).alias("dist"), "rank")


@query(f"""WITH {_BASE}, a AS (SELECT video, shot, release, shot % 7 + 1 AS track FROM s), g AS (SELECT video, frame, track * 10 + video % 3 AS gid, x + 15 AS x, y, w, h FROM p WHERE track < 6),
i AS (SELECT DISTINCT p.* FROM a JOIN p ON p.video = a.video AND p.track = a.track AND p.frame BETWEEN release - 3 AND release + 12),
u AS (SELECT i.video, i.frame, i.track, gid, {_share("i", "g")} AS iou FROM i JOIN g ON g.video = i.video AND g.frame = i.frame),
v AS (SELECT video, frame, track, arg_max(gid, (iou, gid)) AS gid FROM u WHERE iou >= 0.5 GROUP BY ALL),
c AS (SELECT a.video, a.shot, gid, count(*) AS n, -min(frame) AS f FROM a JOIN v ON v.video = a.video AND v.track = a.track AND v.frame BETWEEN release - 3 AND release + 12 GROUP BY ALL)
SELECT a.video, a.shot, arg_max(gid, (n, f, gid)) AS gid FROM a LEFT JOIN c ON c.video = a.video AND c.shot = a.shot GROUP BY ALL""")
def j7_track_owners(spark, sf_dir):
    persons, b = _persons(spark, sf_dir), F.col("box")
    truth = persons.where("track < 6").select("video", "frame", (F.col("track") * 10 + F.col("video") % 3).alias("gid"), geometry.box(b["x"] + 15, b["y"], b["w"], b["h"]).alias("true_box"))
    tracks = _shots(spark, sf_dir).withColumn("track", (F.col("shot") % 7 + 1).cast("int"))
    return spatial.track_owners(tracks, persons, truth, "gid", ["shot"])


_THROWS = """c AS (SELECT c_custkey AS video, c_custkey % 13 + 2 AS vx, c_nationkey % 9 - 4 AS vy FROM customer),
d AS (SELECT video, 0 AS track, k AS frame, 500.0 + vx * k AS x, 400.0 + vy * k AS y, 20.0 + video % 10 AS size, ((video * 7 + k * 11) % 40 + 24) / 64.0 AS conf, (video * 3 + k * k) % 7 <> 3 AS seen FROM c, unnest(range(0, 41)) AS u(k)
UNION ALL SELECT video, 1, k, 4000.0 + vx * k, 900.0 - vy * k, 30.0 + video % 10, ((video * 5 + k * 3) % 40 + 24) / 64.0, (video + k * k) % 5 <> 1 FROM c, unnest(range(20, 61)) AS u(k))"""


def _throws(spark, sf_dir):
    """Detections of two balls for each customer, which fly straight, far from each other and with some frames missing."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video"), (F.col("c_custkey") % 13 + 2).alias("vx"), (F.col("c_nationkey") % 9 - 4).alias("vy"))
    c = _by_video(c)
    v, k = F.col("video"), F.col("frame")
    one = c.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(40)))).where((v * 3 + k * k) % 7 != 3).select("video", "frame", (500.0 + F.col("vx") * k).alias("cx"), (400.0 + F.col("vy") * k).alias("cy"), (20.0 + v % 10).alias("s"), (((v * 7 + k * 11) % 40 + 24) / 64.0).alias("conf"))
    two = c.withColumn("frame", F.explode(F.sequence(F.lit(20), F.lit(60)))).where((v + k * k) % 5 != 1).select("video", "frame", (4000.0 + F.col("vx") * k).alias("cx"), (900.0 - F.col("vy") * k).alias("cy"), (30.0 + v % 10).alias("s"), (((v * 5 + k * 3) % 40 + 24) / 64.0).alias("conf"))
    s = F.col("s")
    return one.withColumn("det_seq", k.cast("long")).unionByName(two.withColumn("det_seq", k.cast("long") + 100)).select("video", "det_seq", "frame", (F.col("cx") - s / 2).alias("x"), (F.col("cy") - s / 2).alias("y"), s.alias("w"), s.alias("h"), "conf")


@query(f"""WITH {_THROWS}, n AS (SELECT *, lead(frame) OVER (PARTITION BY video, track ORDER BY frame) AS nx FROM d WHERE seen), s AS (SELECT video, track, sum(conf) AS score FROM n GROUP BY ALL),
gaps AS (SELECT video, track, unnest(range(frame + 1, nx)) AS frame FROM n WHERE nx - frame BETWEEN 2 AND 12),
e AS (SELECT video, track, frame, x, y, size, conf, 1 AS state FROM n UNION ALL SELECT d.video, d.track, d.frame, x, y, size, 0.0, 2 FROM gaps JOIN d ON d.video = gaps.video AND d.track = gaps.track AND d.frame = gaps.frame),
r AS (SELECT e.*, row_number() OVER (PARTITION BY e.video, frame ORDER BY score DESC, e.track) AS k FROM e JOIN s ON s.video = e.video AND s.track = e.track)
SELECT video, CAST(frame AS INTEGER) AS frame, round(CAST(x AS DOUBLE), 3) AS x, round(CAST(y AS DOUBLE), 3) AS y, CAST(size AS DOUBLE) AS size, CAST(conf AS DOUBLE) AS conf, CAST(track AS BIGINT) AS track, CAST(state AS INTEGER) AS state FROM r WHERE k = 1""")
def z7_ball_track(spark, sf_dir):
    return tracking.ball_track(_throws(spark, sf_dir)).withColumns({"x": _R("x", 3), "y": _R("y", 3)})


_FEATURED = _PAIRS.replace("us / 1e6 AS at", "CAST(s AS DOUBLE) AS at").replace("JOIN t p ON", "JOIN f p ON").replace("p.at", "p.pat").replace("p.event_id AS j", "p.s AS j").replace("c AS (SELECT g.user_id", "f AS (SELECT user_id, s, event_type, min(value) AS value, min(t.at) AS pat FROM t GROUP BY ALL), c AS (SELECT g.user_id")


@query(f"""WITH RECURSIVE {_FEATURED} SELECT m.user_id AS video, i AS event_id, a.at, a.value > 30 AS label_made, CASE WHEN a.event_id % 3 = 0 THEN 'ft' ELSE 'inside_arc' END AS label_zone, f.value > 30 AS pred_made, round(f.value, 4) AS feature
FROM m JOIN t a ON a.event_id = i JOIN f ON f.user_id = m.user_id AND f.s = j AND f.event_type = 'purchase'""")
def z13_shot_features(spark, sf_dir):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("video"), "event_id", seconds.alias("s"), "value", "event_type")
    labels = rows.where("event_type = 'click'").select("video", "event_id", F.col("s").cast("double").alias("timestamp_s"), (F.col("value") > 30).alias("made"), F.when(F.col("event_id") % 3 == 0, "ft").otherwise("inside_arc").alias("zone"))
    found = rows.where("event_type = 'purchase'").groupBy("video", F.col("s").alias("release")).agg(F.min("value").alias("v")).select("video", "release", (F.col("v") > 30).alias("made"), F.array("v").alias("features"))
    return analysis.shot_features(found, labels, 1.0, 3600.0).withColumn("feature", _R(F.get("features", F.lit(0)))).drop("features")


_WALKS = """c AS (SELECT s_suppkey AS video, s_suppkey % 5 + 2 AS v, unnest(range(0, 40)) AS k FROM supplier),
d AS (SELECT video, k AS frame, 0 AS who, 100 + v * k AS x, 300 AS y, 0.9 AS conf FROM c
UNION ALL SELECT video, k, 1, 100 + v * (34 - k), 330, CASE WHEN k BETWEEN 12 AND 22 THEN 0.3 ELSE 0.8 END FROM c WHERE k < 2 OR (video + k) % 11 <> 5
UNION ALL SELECT video, k, 2, 2000 + k, 900, CASE WHEN k % 2 = 0 THEN 0.55 ELSE 0.05 END FROM c WHERE k % 7 = 3)"""


def _walks(spark, sf_dir):
    """Two persons for each supplier who walk through each other; the one behind is half hidden there (unsure boxes), and
    unseen in some frames; and boxes that are too unsure to begin a track."""
    c = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video"), (F.col("s_suppkey") % 5 + 2).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    k, v = F.col("k"), F.col("v")
    box = lambda who, x, y, conf: c.select("video", k.alias("frame"), F.lit(who).alias("det_seq"), x.cast("double").alias("x"), F.lit(y).alias("y"), F.lit(60.0).alias("w"), F.lit(160.0).alias("h"), conf.alias("conf"))
    one = box(0, 100 + v * k, 300.0, F.lit(0.9))
    two = box(1, 100 + v * (34 - k), 330.0, F.when(k.between(12, 22), 0.3).otherwise(0.8)).where((F.col("frame") < 2) | ((F.col("video") + F.col("frame")) % 11 != 5))
    none = box(2, 2000 + k, 900.0, F.when(k % 2 == 0, 0.55).otherwise(0.05)).where("frame % 7 = 3")
    return one.unionByName(two).unionByName(none)


@query(f"""WITH {_WALKS}, n AS (SELECT *, row_number() OVER w AS n, max(CASE WHEN conf >= 0.5 THEN frame END) OVER w AS sure FROM d WINDOW w AS (PARTITION BY video, who ORDER BY frame)),
s AS (SELECT *, max(CASE WHEN conf >= 0.5 THEN n END) OVER (PARTITION BY video, who ORDER BY frame) AS sure_n FROM n)
SELECT video, frame, who AS det_seq, CASE WHEN who < 2 AND (conf >= 0.5 OR n - sure_n = frame - sure) THEN CAST(who AS BIGINT) END AS track_id FROM s""")
def s2_person_tracks(spark, sf_dir):
    return persons.person_tracks(_walks(spark, sf_dir)).select("video", F.col("frame").cast("long").alias("frame"), "det_seq", "track_id")


_RIVALS = """c AS (SELECT c_custkey AS video, c_custkey % 5 + 3 AS vx, c_nationkey % 7 - 3 AS vy, c_custkey % 4 AS kind, unnest(range(0, 48)) AS k FROM customer),
d AS (SELECT video, k AS frame, 0 AS det_seq, 500.0 + vx * k AS cx, 400.0 + vy * k + (k % 3) * 2 AS cy, 24.0 AS w, 24.0 AS h, ((video + k * 3) % 40 + 20) / 64.0 AS conf FROM c WHERE (video + k * k) % 9 <> 4 AND k < 40
UNION ALL SELECT video, k, 1, 500.0 + vx * (44 - k), 404.0 + vy * (36 - k), 32.0, 26.0, ((video * 3 + k * 7) % 40 + 20) / 64.0 FROM c WHERE (video + k) % 6 <> 2 OR k < 3
UNION ALL SELECT video, k, 2, 508.0 + vx * k, 396.0 + vy * k, 20.0, 20.0, ((video * 11 + k) % 64) / 64.0 FROM c WHERE k % 4 = kind
UNION ALL SELECT video, k, 3, 560.0 + (video * 13 + k * 29) % 400, 420.0 + (video * 7 + k * 17) % 160, 20.0, 20.0 + k % 30, ((video * 5 + k * 13) % 32 + 4) / 64.0 FROM c WHERE k % 3 = 1
UNION ALL SELECT video, k, 4, 500.0 + vx * k, 400.0 + vy * k, CASE kind WHEN 0 THEN 6.0 WHEN 1 THEN 130.0 ELSE 24.0 END, CASE kind WHEN 0 THEN 6.0 WHEN 1 THEN 130.0 ELSE 60.0 END, 1.0 FROM c WHERE k % 2 = 0
UNION ALL SELECT video, k, 5, 3000.0 + k * 3, 2000.0 - k * k, 40.0, 40.0, 0.75 FROM c WHERE k IN (5, 6 + kind))"""


def _rivals(spark, sf_dir):
    """Detections for each customer that contest each other: two balls that fly through each other with frames missing,
    detections beside the first that merge with it or rival it, others at random places of all confidences and shapes, some
    too small, too large or too long, and a ball that is seen twice."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video"), (F.col("c_custkey") % 5 + 3).alias("vx"), (F.col("c_nationkey") % 7 - 3).alias("vy"), (F.col("c_custkey") % 4).alias("kind"))
    c = _by_video(c).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(47))))
    v, k, vx, vy, kind = (F.col(n) for n in ("video", "k", "vx", "vy", "kind"))
    real = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")

    def seen(seq, keep, cx, cy, w, h, conf):
        left, top = real(cx) - real(w) / 2, real(cy) - real(h) / 2
        return c.where(keep).select("video", F.lit(seq).cast("long").alias("det_seq"), k.alias("frame"), left.alias("x"), top.alias("y"), real(w).alias("w"), real(h).alias("h"), real(conf).alias("conf"))

    odd = F.when(kind == 0, 6.0).when(kind == 1, 130.0)
    parts = [
        seen(0, ((v + k * k) % 9 != 4) & (k < 40), 500 + vx * k, 400 + vy * k + (k % 3) * 2, 24, 24, ((v + k * 3) % 40 + 20) / 64),
        seen(1, ((v + k) % 6 != 2) | (k < 3), 500 + vx * (44 - k), 404 + vy * (36 - k), 32, 26, ((v * 3 + k * 7) % 40 + 20) / 64),
        seen(2, k % 4 == kind, 508 + vx * k, 396 + vy * k, 20, 20, ((v * 11 + k) % 64) / 64),
        seen(3, k % 3 == 1, 560 + (v * 13 + k * 29) % 400, 420 + (v * 7 + k * 17) % 160, 20, 20 + k % 30, ((v * 5 + k * 13) % 32 + 4) / 64),
        seen(4, k % 2 == 0, 500 + vx * k, 400 + vy * k, F.coalesce(odd, F.lit(24.0)), F.coalesce(odd, F.lit(60.0)), 1),
        seen(5, (k == 5) | (k == 6 + kind), 3000 + k * 3, 2000 - k * k, 40, 40, 0.75),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


_NEAR = "sqrt((o.x - c[1].x) ** 2 + (o.y - c[1].y) ** 2) < 0.7 * greatest(o.d, c[1].d)"
_LINKED = f"""{_RIVALS}, fit AS (SELECT *, (w + h) / 2 AS size FROM d WHERE conf >= 0.15 AND (w + h) / 2 BETWEEN 8 AND 100 AND greatest(w, h) / greatest(least(w, h), 1e-6) <= 1.7),
g AS (SELECT video, frame, list([{{'x': CAST(cx AS DOUBLE), 'y': CAST(cy AS DOUBLE), 'd': CAST(size AS DOUBLE), 'conf': CAST(conf AS DOUBLE)}}] ORDER BY det_seq) AS c FROM fit GROUP BY ALL),
m AS (SELECT video, frame, list_reduce(c, lambda a, c: CASE WHEN len(list_filter(a, lambda o: {_NEAR})) = 0 THEN a || c
  ELSE list_transform(a, lambda o, i: CASE WHEN i = list_position(list_transform(a, lambda o: {_NEAR}), true) AND c[1].conf > o.conf THEN c[1] ELSE o END) END) AS c FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS k FROM m),
w AS (SELECT video, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS frame, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, vx DOUBLE, vy DOUBLE, last BIGINT, hits BIGINT)[]) AS open, CAST(0 AS BIGINT) AS made, CAST([] AS STRUCT(t BIGINT, j BIGINT)[]) AS got FROM (SELECT DISTINCT video FROM r)
UNION ALL SELECT video, k, frame, list_transform(alive, lambda t, i: CASE WHEN len(list_filter(pairs, lambda p: p.i = i)) = 0 THEN t ELSE
    {{'id': t.id, 'x': c[list_filter(pairs, lambda p: p.i = i)[1].j].x, 'y': c[list_filter(pairs, lambda p: p.i = i)[1].j].y,
      'vx': CASE WHEN t.hits = 1 THEN 0 ELSE 0.5 * t.vx END + CASE WHEN t.hits = 1 THEN 1 ELSE 0.5 END * ((c[list_filter(pairs, lambda p: p.i = i)[1].j].x - t.x) / (frame - t.last)),
      'vy': CASE WHEN t.hits = 1 THEN 0 ELSE 0.5 * t.vy END + CASE WHEN t.hits = 1 THEN 1 ELSE 0.5 END * ((c[list_filter(pairs, lambda p: p.i = i)[1].j].y - t.y) / (frame - t.last)),
      'last': frame, 'hits': t.hits + 1}} END)
    || list_transform(new, lambda j, n: {{'id': made + n - 1, 'x': c[j].x, 'y': c[j].y, 'vx': 0.0, 'vy': 0.0, 'last': frame, 'hits': 1}}),
  made + len(new), list_transform(pairs, lambda p: {{'t': alive[p.i].id, 'j': p.j}}) || list_transform(new, lambda j, n: {{'t': made + n - 1, 'j': j}})
  FROM (SELECT *, list_filter(range(1, len(c) + 1), lambda j: c[j].conf >= 0.3 AND NOT list_contains(list_transform(pairs, lambda p: p.j), j)) AS new FROM
    (SELECT *, CASE WHEN len(all_pairs) = 0 THEN [] ELSE list_reduce(list_transform(list_sort(all_pairs), lambda p: [p]), lambda a, p: CASE WHEN len(list_filter(a, lambda q: q.i = p[1].i OR q.j = p[1].j)) = 0 THEN a || p ELSE a END) END AS pairs FROM
      (SELECT *, list_filter(flatten(list_transform(range(1, len(alive) + 1), lambda i: list_transform(range(1, len(c) + 1), lambda j:
          {{'cost': sqrt((c[j].x - (alive[i].x + alive[i].vx * (frame - alive[i].last))) ** 2 + (c[j].y - (alive[i].y + alive[i].vy * (frame - alive[i].last))) ** 2) /
              (45 + 20 * (frame - alive[i].last - 1) + 1.5 * sqrt(alive[i].vx ** 2 + alive[i].vy ** 2) * (frame - alive[i].last)) - 0.3 * c[j].conf, 'i': i, 'j': j}}))), lambda p: p.cost + 0.3 * c[p.j].conf < 1) AS all_pairs FROM
        (SELECT w.video, r.k, r.frame, r.c, w.made, list_filter(w.open, lambda t: r.frame - t.last <= 12) AS alive FROM w JOIN r ON r.video = w.video AND r.k = w.k + 1)))))"""


@query(f"""WITH RECURSIVE {_LINKED}, t AS (SELECT video, frame, k, unnest(got) AS g FROM w), x AS (SELECT t.video, g.t AS track, t.frame, r.c[g.j] AS c FROM t JOIN r ON r.video = t.video AND r.k = t.k)
SELECT video, track, CAST(frame AS INTEGER) AS frame, c.x AS x, c.y AS y, c.d AS size, c.conf AS conf FROM x WINDOW t AS (PARTITION BY video, track) QUALIFY count(*) OVER t >= 4 OR count(*) OVER t >= 2 AND max(c.conf) OVER t >= 0.6""")
def s1_contested_tracks(spark, sf_dir):
    return tracking.tracks_of(_rivals(spark, sf_dir))


_TRIALS = "e AS (SELECT event_type AS fold, CAST(value > 40 AS INTEGER) AS x1, user_id % 2 AS x2, CAST((event_id * 7919) % 1000 < 250 + CASE WHEN value > 40 THEN 350 ELSE 0 END + 200 * (user_id % 2) AS INTEGER) AS y FROM events), c AS (SELECT fold, x1, x2, count(*) AS n, sum(y) AS y FROM e GROUP BY ALL), t AS (SELECT x1, x2, sum(n) AS n, sum(y) AS y FROM c GROUP BY ALL)"


def _trials(spark, sf_dir):
    """Events with two traits and their product, so that a model without a penalty gives each cell its own share of successes."""
    a, b = (F.col("value") > 40).cast("int"), (F.col("user_id") % 2).cast("int")
    rows = _read(spark, sf_dir, "events").select(F.col("event_type").alias("fold"), a.alias("x1"), b.alias("x2"), ((F.col("event_id") * 7919) % 1000 < 250 + 350 * a + 200 * b).cast("int").alias("y"))
    return rows.withColumn("x", F.array(*(F.col(c).cast("double") for c in ("x1", "x2")), (F.col("x1") * F.col("x2")).cast("double")))


@query(f"WITH {_TRIALS} SELECT c.fold, c.x1, CAST(c.x2 AS INTEGER) AS x2, round((t.y - c.y) / (t.n - c.n), 6) AS prob FROM c JOIN t ON c.x1 = t.x1 AND c.x2 = t.x2 UNION ALL SELECT 'all', x1, CAST(x2 AS INTEGER), round(y / n, 6) FROM t")
def m1_fit_by_fold(spark, sf_dir):
    rows = _trials(spark, sf_dir)
    fitted = models.fit_by_fold(rows, "fold", "x", "y", penalty=0.0)
    cells, x = rows.select("x1", "x2", "x").distinct(), F.col("x")
    scored = [cells.select(F.lit("all" if f is ... else f).alias("fold"), "x1", "x2", _R(values.logistic([F.get(x, F.lit(i)) for i in range(3)], m["mean"], m["std"], m["w"], m["b"]), 6).alias("prob")) for f, m in fitted.items()]
    return functools.reduce(DataFrame.unionByName, scored)


@query(f"WITH {_TRIALS} SELECT c.fold, CAST(sum(c.n) AS BIGINT) AS n, CAST(sum(CASE WHEN (t.y - c.y) / (t.n - c.n) > 0.5 THEN c.y ELSE c.n - c.y END) AS BIGINT) AS \"right\" FROM c JOIN t ON c.x1 = t.x1 AND c.x2 = t.x2 GROUP BY c.fold")
def m2_leave_one_out(spark, sf_dir):
    return models.leave_one_out(_trials(spark, sf_dir), "fold", "x", "y", penalty=0.0)


_COLOURS = """c AS (SELECT c_custkey AS id, c_custkey % 37 = 5 AS stray, CASE WHEN c_custkey % 37 = 5 OR c_custkey % 2 = 0 THEN 3 ELSE 11 END AS hue, (c_custkey % 20) / 20.0 AS saturated FROM customer),
b AS (SELECT *, unnest(range(0, 72)) AS i FROM c), v AS (SELECT *, CASE WHEN stray AND i // 4 = 7 THEN 40 + i % 4 WHEN i // 4 = hue THEN 1 + (id * (i % 4 + 1)) % 7 WHEN i // 4 = hue + 1 AND NOT stray THEN 1 ELSE 0 END AS m FROM b),
u AS (SELECT id, hue, saturated, i, sqrt(m / sum(m) OVER (PARTITION BY id)) AS v FROM v), k AS (SELECT hue, i, avg(v) AS v FROM u GROUP BY ALL),
f AS (SELECT u.id, u.saturated, k.hue, sqrt(sum((u.v - k.v) ** 2)) AS d FROM u JOIN k ON k.i = u.i GROUP BY ALL), n AS (SELECT id, saturated, min(d) AS d, arg_min(hue, d) AS hue FROM f GROUP BY ALL)"""


def _colours(spark, sf_dir):
    """A colour vector for each customer: hues of one of two groups, or mostly of a third one; and a share of saturated pixels."""
    k = F.col("c_custkey")
    stray = k % 37 == 5
    hue = F.when(stray | (k % 2 == 0), 3).otherwise(11)
    mass = lambda i: F.when(stray & (F.floor(i / 4) == 7), 40 + i % 4).when(F.floor(i / 4) == hue, 1 + (k * (i % 4 + 1)) % 7).when((F.floor(i / 4) == hue + 1) & ~stray, 1).otherwise(0).cast("double")
    rows = _read(spark, sf_dir, "customer").select(k.alias("id"), (F.col("c_custkey") % 20 / 20.0).alias("saturated"), F.transform(F.sequence(F.lit(0), F.lit(71)), mass).alias("m"))
    total = F.aggregate("m", F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", "saturated", F.transform("m", lambda x: F.sqrt(x / total)).alias("v"))


@query(f"WITH {_COLOURS} SELECT id, CASE WHEN saturated < 0.15 OR d > 1.25 * (SELECT quantile_cont(d, 0.975) FROM n) THEN '?' WHEN hue = 3 THEN 'A' ELSE 'B' END AS team, round(d, 6) AS d FROM n")
def m3_team_colours(spark, sf_dir):
    rows = _colours(spark, sf_dir)
    model = models.team_colours(rows, "v")
    far = F.least(*(F.sqrt(values.squared_distance(F.col("v"), F.array(*(F.lit(x) for x in c)))) for c in model["centres"]))
    return rows.select("id", models.team_of(F.col("v"), F.col("saturated"), model).alias("team"), _R(far, 6).alias("d"))


_FEATURES = """cand AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY video, shot ORDER BY round(dist, 9), track) AS k FROM
    (SELECT s.video, s.shot, s.release, p.track, median(sqrt(greatest(0, abs(bx - (x + w / 2)) - w / 2) ** 2 + (greatest(0, bv - (y + 0.45 * h)) + greatest(0, (y - 0.4 * h) - bv)) ** 2) / h) AS dist FROM s JOIN b ON b.video = s.video AND b.frame BETWEEN release - release % 3 AND release + 18 JOIN p ON p.video = b.video AND p.frame = b.frame GROUP BY ALL) c) WHERE k <= 5),
c AS (SELECT cand.*, near.dist AS near, row_number() OVER (PARTITION BY cand.video, cand.shot ORDER BY coalesce(round(near.dist, 9), 9), k) = 1 AS lead FROM cand LEFT JOIN near ON near.video = cand.video AND near.shot = cand.shot AND near.track = cand.track),
own AS (SELECT c.video, c.shot, c.track, c.release, p.frame AS seen, x, y, w, h FROM c JOIN p ON p.video = c.video AND p.track = c.track AND p.frame BETWEEN release - 46 AND release + 19),
tall AS (SELECT video, shot, track, median(h) AS tall FROM own WHERE seen BETWEEN release - 6 AND release + 18 GROUP BY ALL),
bx AS (SELECT *, seen + unnest([-1, 0, 1]) AS frame FROM own), box AS (SELECT *, frame - release AS d FROM bx WHERE frame - release BETWEEN -45 AND 18 QUALIFY row_number() OVER (PARTITION BY video, shot, track, frame ORDER BY seen) = 1),
m AS (SELECT box.*, b.bx, b.bv, CASE WHEN d >= 0 AND bx IS NOT NULL THEN sqrt(greatest(0, abs(bx - (x + w / 2)) - w / 2) ** 2 + (greatest(0, bv - (y + 0.45 * h)) + greatest(0, (y - 0.4 * h) - bv)) ** 2) / h END AS dist,
  coalesce(bx BETWEEN x - 0.1 * w AND x + 1.1 * w AND bv BETWEEN y - 0.1 * h AND y + 0.8 * h, false) AS has FROM box LEFT JOIN b ON b.video = box.video AND b.frame = box.frame),
ft AS (SELECT video, shot, track, median(dist) FILTER (d >= 9) AS late, min(dist) AS least, avg((y - bv) / h) FILTER (d BETWEEN 0 AND 12) AS above, avg(abs(bx - (x + w / 2)) / w) FILTER (d BETWEEN 0 AND 12) AS aside,
  (max(y + h) FILTER (d = -6) - min(y + h) FILTER (d BETWEEN 0 AND 15)) / max(h) FILTER (d = -6) AS jump,
  count(*) FILTER (has AND frame % 3 = 0 AND d BETWEEN -15 AND 3) / nullif(count(*) FILTER (frame % 3 = 0 AND d BETWEEN -15 AND 3), 0) AS short, count(*) FILTER (has AND frame % 3 = 0 AND d BETWEEN -45 AND -15) / nullif(count(*) FILTER (frame % 3 = 0 AND d BETWEEN -45 AND -15), 0) AS long FROM m GROUP BY ALL)"""


@query(f"""WITH {_BASE}, {_FEATURES} SELECT c.video, c.shot, c.track, round(coalesce(near, 3), 6) AS d_near, round(coalesce(late, 3), 6) AS d_late, round(coalesce(least, 3), 6) AS d_min, round(coalesce(short, 0), 6) AS held_short, round(coalesce(long, 0), 6) AS held_long, round(coalesce(above, -1), 6) AS ball_above, round(coalesce(aside, 2), 6) AS x_off,
round(coalesce(jump, 0), 6) AS jump, round(coalesce(tall / max(tall) OVER (PARTITION BY c.video, c.shot), 1), 6) AS rel_height, CAST(lead AS DOUBLE) AS is_nearest FROM c LEFT JOIN ft ON ft.video = c.video AND ft.shot = c.shot AND ft.track = c.track LEFT JOIN tall ON tall.video = c.video AND tall.shot = c.shot AND tall.track = c.track""")
def m4_choice_features(spark, sf_dir):
    found = composites.choice_features(_shots(spark, sf_dir), _persons(spark, sf_dir), _ball(spark, sf_dir))
    return found.select("video", "shot", "track", *(_R(F.get("features", F.lit(i)), 6).alias(n) for i, n in enumerate(composites.CHOICE_FEATURES)))


_PIXELS = """v AS (SELECT s_suppkey AS video, unnest(range(0, 24)) AS frame FROM supplier), f AS (SELECT * FROM v WHERE (video + frame * frame) % 11 <> 3), x AS (SELECT video, frame, unnest(range(0, 64)) AS p FROM f),
c AS (SELECT video, frame, p, CASE WHEN (p * 5 + video) % 3 = 0 AND video % 4 = 0 THEN 2 ELSE (p * 7 + frame * (video % 5 + 1) + video) % 4 END AS c FROM x)"""


def _pictures(spark, sf_dir):
    """Pictures of 8 x 8 pixels in four colours (orange, dim orange, green, black), 24 a supplier, some of them missing."""
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("frame"))
    rows = rows.where((F.col("video") + F.col("frame") * F.col("frame")) % 11 != 3)
    v, f = F.col("video"), F.col("frame")
    kind = lambda p: F.when(((p * 5 + v) % 3 == 0) & (v % 4 == 0), 2).otherwise((p * 7 + f * (v % 5 + 1) + v) % 4).cast("int")
    inks = F.array(*(F.lit(x) for x in ("0080FF", "00468C", "00FF00", "000000")))
    image = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.element_at(inks, kind(p) + 1)), ""))
    return rows.select("video", "frame", image.alias("image"), F.lit(8).alias("height"), F.lit(8).alias("width"))


@query(f"""WITH {_PIXELS}, g AS (SELECT *, [152, 83, 150, 0][c + 1] AS g FROM c)
SELECT f.video, f.frame, count(*) FILTER (a.c < 2 AND abs(a.g - b.g) > 25) AS score FROM f LEFT JOIN g a ON a.video = f.video AND a.frame = f.frame LEFT JOIN g b ON b.video = a.video AND b.frame = a.frame - 1 AND b.p = a.p GROUP BY ALL""")
def w11_moving_colour(spark, sf_dir):
    return pixels.moving_score(_pictures(spark, sf_dir), piece=7)


@query(f"""WITH {_PIXELS}, n AS (SELECT video, frame, count(*) FILTER (c < 3) AS n, count(*) FILTER (c < 2) AS orange, count(*) FILTER (c = 2) AS green FROM c GROUP BY ALL)
SELECT video, frame, n / 64 AS share, CASE WHEN n >= 20 THEN round(sqrt(orange / n), 6) END AS orange, CASE WHEN n >= 20 THEN round(sqrt(green / n), 6) END AS green FROM n""")
def h16_colour_vectors(spark, sf_dir):
    rows = _pictures(spark, sf_dir).select("video", "frame", pixels.colour_column("image", "height", "width").alias("c"))
    at = lambda k: _R(F.get("c.vector", F.lit(k)), 6)
    return rows.select("video", "frame", "c.share", at(7).alias("orange"), at(27).alias("green"))


@query(f"WITH {_PIXELS} SELECT video, frame, CASE WHEN count(*) FILTER (c < 3) >= 0.3 * 64 THEN median(CASE WHEN c < 2 THEN 15.0 ELSE 60.0 END) FILTER (c < 3) END AS hue FROM c GROUP BY ALL")
def h17_court_hues(spark, sf_dir):
    return _pictures(spark, sf_dir).select("video", "frame", pixels.court_hue_column("image").alias("hue"))


@query(f"""WITH {_PIXELS}, i AS (SELECT video, frame, p // 16 AS y, (p % 8) // 2 AS x, unnest(range(0, 3)) AS k, c FROM c), means AS (SELECT video, frame, y, x, k, round_even(avg([[0, 128, 255], [0, 70, 140], [0, 255, 0], [0, 0, 0]][c + 1][k + 1]), 0) AS v FROM i GROUP BY ALL)
SELECT video, frame, string_agg(printf('%02X', CAST(v AS INTEGER)), '' ORDER BY y, x, k) AS pixels FROM means GROUP BY video, frame""")
def h18_letterbox(spark, sf_dir):
    """Pictures at half their size: each pixel is the mean of four."""
    return _pictures(spark, sf_dir).select("video", "frame", F.hex(pixels.letterbox_column("image", "height", "width", 4)).alias("pixels"))


@query(f"WITH {_PIXELS} SELECT video, frame, count(*) FILTER (c = 3) / 64 AS black, count(DISTINCT c) / 4 AS kinds FROM c GROUP BY ALL")
def m8_batch_scores(spark, sf_dir):
    """A stand-in for a model that is loaded once a task and asked for batches of pictures."""

    def load():
        import numpy as np

        def model(images):
            x = [np.frombuffer(i, np.uint8).reshape(-1, 3) for i in images]
            return [[float((p == 0).all(1).mean()), len(np.unique(p, axis=0)) / 4] for p in x]

        return model

    found = models.batch_scores(_pictures(spark, sf_dir), "image", load, 2)
    return found.select("video", "frame", F.col("probs")[0].alias("black"), F.col("probs")[1].alias("kinds"))


@query("""WITH c AS (SELECT s_suppkey AS k FROM supplier), v AS (SELECT 1.575 + sqrt(6.75 * 6.75 - 6.6 * 6.6) AS cut, asin(6.6 / 6.75) AS wide), l AS (
SELECT unnest(['baseline', 'baseline', 'far', 'far', 'left', 'left', 'right', 'right', 'lane', 'lane', 'lane', 'lane']) AS line, unnest([0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 2, 3]) AS seq, unnest([-7.5, 7.5, -7.5, 7.5, -7.5, -7.5, 7.5, 7.5, -2.45, -2.45, 2.45, 2.45]) AS x, unnest([0, 0, 11, 11, 0, 11, 0, 11, 0, 5.8, 5.8, 0]) AS y
UNION ALL SELECT line, seq, sign * 6.6, CASE WHEN seq = 0 THEN 0 ELSE cut END FROM v, (SELECT unnest(['corner_left', 'corner_left', 'corner_right', 'corner_right']) AS line, unnest([0, 1, 0, 1]) AS seq, unnest([-1, -1, 1, 1]) AS sign)
UNION ALL SELECT 'arc', i, 6.75 * sin(wide * (1 - 2 * i / 119)), 1.575 + 6.75 * cos(wide * (1 - 2 * i / 119)) FROM v, range(0, 120) t(i))
SELECT k AS video, line, CAST(seq AS INTEGER) AS seq, round(CAST(((k % 9 + 20) * x + 3 * y + 900) / (0.01 * (k % 4) * y + 1) AS DOUBLE), 4) AS x, round(CAST((-(k % 7 + 15) * y + 800) / (0.01 * (k % 4) * y + 1) AS DOUBLE), 4) AS y FROM c, l""")
def h7_court_overlays(spark, sf_dir):
    k = F.col("s_suppkey")
    h = [k % 9 + 20, F.lit(3), F.lit(900), F.lit(0), -(k % 7 + 15), F.lit(800), F.lit(0), 0.01 * (k % 4), F.lit(1)]
    cameras = _read(spark, sf_dir, "supplier").select(k.alias("video"), F.array(*(v.cast("double") for v in h)).alias("to_image"))
    found = datasets.court_overlays(cameras, "fiba_3x3")
    return found.select("video", "line", "seq", _R("x", 4).alias("x"), _R("y", 4).alias("y"))
