"""Answers put together from the operators: who shot, from where, for which team, and how right that was.

persons has (video, frame, track, box), shots (video, shot, release), track (video, frame, x, y) of the ball. Every join has
the video and, but for nearest frames, the frame or the shot in its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions import court as courts
from trackmill.functions.geometry import foot_point, overlap_share, project
from trackmill.functions.values import ratio
from trackmill.operators import releases
from trackmill.operators.aggregates import majority, weighted_vote
from trackmill.operators.matching import floor_aligned, in_window, one_to_one, unmatched
from trackmill.operators.spatial import possession

SHOT = ["video", "shot"]


def near_release(shots: DataFrame, persons: DataFrame, track: DataFrame, every: int = 3, ahead: int = 9) -> DataFrame:
    """(video, shot, track, dist, n): each player's median distance of the hands to the ball after a release, on sampled frames."""
    return releases.near_rows(shots, persons, track, every, ahead)


def ranked_shooters(near: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Candidates with their rank (from 1): nearest first (to nine decimals), then most often seen, then the smallest track.

    held (video, shot, track, frames), as held_before gives it, ranks those first who had the ball in more frames; a
    player who had it but isn't seen near the release is a candidate too, with a null distance.
    """
    order = [F.round("dist", 9).asc_nulls_last(), F.desc("n"), F.col("track")]
    if held is not None:
        near = near.join(held.select(*SHOT, "track", F.col("frames").alias("held")), [*SHOT, "track"], "full").withColumn("held", F.coalesce("held", F.lit(0)))
        order = [F.desc("held"), *order]
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*SHOT).orderBy(*order)))


def held_before(shots: DataFrame, persons: DataFrame, track: DataFrame, balls: DataFrame | None = None, every: int = 3, before: int = 12, least: float = 0.15) -> DataFrame:
    """(video, shot, track, frames): in how many sampled frames before a release a player has the ball, by the track or, of
    balls (video, frame, x, y, w, h, conf), by a raw detection of some confidence."""
    first = F.col("release") - before
    frames = F.explode(F.sequence((first - F.pmod(first, F.lit(every))).cast("int"), F.col("release").cast("int"), F.lit(every)))
    points = track.where("x is not null and y is not null").select("video", "frame", F.col("x").alias("px"), F.col("y").alias("py"))
    if balls is not None:
        points = points.unionByName(balls.where(F.col("conf") >= least).select("video", "frame", (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py")))
    asked = shots.select(*SHOT, frames.alias("frame")).join(points, ["video", "frame"])
    return possession(asked, persons.where("track >= 0").select("video", "frame", "track", "box"), ["video", "frame"], "track", "box", F.col("px"), F.col("py"), by=["shot"])


CHOICE_FEATURES = ["d_near", "d_late", "d_min", "held_short", "held_long", "ball_above", "x_off", "jump", "rel_height", "is_nearest"]


def choice_features(shots: DataFrame, persons: DataFrame, track: DataFrame, balls: DataFrame | None = None, most: int = 5, least: float = 0.15) -> DataFrame:
    """(video, shot, track, features): CHOICE_FEATURES of the `most` players whose hands are nearest to the ball until 18
    frames after a release, for a model that ranks them (models.fit_choice, models.ranked_by_choice).

    At a frame a player has the first box that is at most one frame away. Distances are near_release's: its median of 9
    frames (3 if unseen), the median from the 9th to the 18th, the least of all 18. Held: the share of sampled frames before
    the release in which a ball, tracked or (balls) a raw detection, lies in the box, over 15 and from 45 to 15 frames.
    Then the ball's height above the box and its distance aside until the 12th frame, in box sizes; how far the feet rise
    above where they were 6 frames before; the median height of the boxes against the tallest candidate; and 1 for the nearest.

    Shots, persons and balls of a stretch of a video meet in a task (see pieces), which makes no rows but the answers.
    """
    points = track.select("video", "frame", "x", "y")
    if balls is not None:
        points = points.unionByName(balls.where(F.col("conf") >= least).select("video", "frame", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y")))
    return releases.choice_rows(shots, persons, track, points, most)


def _placed(persons: DataFrame, h, c: courts.Court) -> DataFrame:
    """persons with their place on the floor (fx, fy) and whether it is on the court."""
    p = project(h, foot_point(F.col("box"))["x"], foot_point(F.col("box"))["y"])
    return persons.select("video", "frame", "track", "box", p["x"].alias("fx"), p["y"].alias("fy")).withColumn("court", courts.on_court(c, F.col("fx"), F.col("fy"), 0.3))


def _calm(most_moved: float, least_gap: float) -> Column:
    return F.coalesce(F.col("moved") <= most_moved, F.lit(False)) & F.coalesce(F.col("gap") >= least_gap, F.lit(True))


def free_throw_context(shooters: DataFrame, persons: DataFrame, h, c: courts.Court, fps: float = 29.97, still: float = 2.0, most_moved: float = 0.4, least_gap: float = 2.5, track: DataFrame | None = None) -> DataFrame:
    """(video, shot, moved, gap, still): shooters (video, shot, release, track) that stood still before, with nobody near. With the
    ball's track they are those of shooter_info, and shooters needs no track.

    moved and gap are null without an earlier place or without another player on the court; no earlier place is no free
    throw, no other player is no hindrance.
    """
    found = releases.stood(shooters, _placed(persons, h, c), track, _earlier(fps, still))
    return found.where("seen").select(*SHOT, "moved", "gap", _calm(most_moved, least_gap).alias("still"))


def _earlier(fps: float, still: float) -> list[int]:
    return [round(k * fps / 2) for k in range(1, int(still * 2) + 1)]


def shooter_info(shots: DataFrame, persons: DataFrame, track: DataFrame, h, c: courts.Court, fps: float = 29.97) -> DataFrame:
    """(video, shot, release, track, score, frame, court_x, court_y, zone) of each shot; nulls where there is nobody or no place."""
    found = releases.stood(shots, _placed(persons, h, c), track, _earlier(fps, 2.0))
    zone = F.when(F.col("fx").isNotNull(), courts.zone_of(c, F.col("fx"), F.col("fy"), F.col("seen") & _calm(0.4, 2.5)))
    return found.select(*SHOT, "release", "track", "score", F.col("frame").cast(persons.schema["frame"].dataType).alias("frame"), F.col("fx").alias("court_x"), F.col("fy").alias("court_y"), zone.alias("zone"))


def track_teams(persons: DataFrame, keyframes: DataFrame, h, c: courts.Court, label: Column, every: int = 3) -> DataFrame:
    """(video, track, known, vote): the team that most of a track's looks at the keyframes (video, frame) give; label is a
    column over persons, such as the nearest of two colour centres."""
    p = project(h, foot_point(F.col("box"))["x"], foot_point(F.col("box"))["y"])
    seen = persons.where((F.col("track") >= 0) & courts.on_court(c, p["x"], p["y"], 0.3)).select("video", "frame", "track", label.alias("label"))
    looks = floor_aligned(keyframes.select("video", "frame"), seen, ["video"], "frame", every).where("track is not null")
    return majority(looks, ["video", "track"], "label")


def shot_teams(shooters: DataFrame, persons: DataFrame, label: str, tracks: DataFrame, before: int = 45, after: int = 15, step: int = 3, most: float = 0.15, least: float = 0.6) -> DataFrame:
    """(video, shot, team): the vote over the shooter's views round the release; over those that nobody overlaps, if one of
    them is known; else the vote of the track (video, track, vote); else '?'. A vote takes the share `least` of the known views.

    How far others cover a view is worked out once a frame, over its few persons, before shots meet their views.
    """
    frames = persons.groupBy("video", "frame").agg(F.collect_list(F.struct("track", "box", label)).alias("_p"))  # few persons
    person = F.col("_o")
    covered = F.array_max(F.transform(F.filter("_p", lambda q: q["track"] != person["track"]), lambda q: overlap_share(person["box"], q["box"])))
    looks = frames.select("video", "frame", "_p", F.explode("_p").alias("_o")).select("video", "frame", person["track"].alias("track"), person[label].alias(label), F.coalesce(covered <= most, F.lit(True)).alias("_clean"))
    own = in_window(shooters.select(*SHOT, "release", "track"), looks, ["video", "track"], "release", "frame", before, after)
    first = F.min("frame").over(Window.partitionBy(*SHOT))  # of a shot's few views
    views = own.withColumn("_first", first).where((F.pmod(F.col("frame") - F.col("_first"), F.lit(step)) == 0) & (F.col(label) != "?"))
    counts = views.groupBy(*SHOT, label).agg(F.count("*").alias("_n"), F.count_if("_clean").alias("_c"))
    used = F.when(F.sum("_c").over(Window.partitionBy(*SHOT)) > 0, F.col("_c")).otherwise(F.col("_n"))
    best = counts.withColumn("_u", used).groupBy(*SHOT).agg(F.max(F.struct("_u", label)).alias("_b"), F.sum("_u").alias("_all"))
    voted = best.select(*SHOT, F.when(F.col("_b._u") >= least * F.col("_all"), F.col(f"_b.{label}")).otherwise("?").alias("vote"))
    both = shooters.select(*SHOT, "track").join(voted.select(*SHOT, F.nullif("vote", F.lit("?")).alias("_v")), SHOT, "left").join(tracks.select("video", "track", F.col("vote").alias("_t")), ["video", "track"], "left")
    return both.select(*SHOT, F.coalesce("_v", "_t", F.lit("?")).alias("team"))


def assign_numbers(crops: DataFrame, numbers: list[int], both_teams: bool = False, k: int = 3, least: float = 0.5) -> DataFrame:
    """(video, shot, team, number) from crops (video, shot, team, probs): the vote over the classes of the team's roster.

    A roster is a team's k classes with most mass in its video. An unknown team may have any number. With both_teams the vote
    is over the classes of either roster, and a number of one roster only decides the team. Shots without a sure crop get
    the number '?'. crops of a shot without views have null probs.
    """
    seen = crops.where(F.col("probs").isNotNull() & (F.size("probs") > 0))
    mass = seen.where((F.col("team") != "?") & (F.array_max("probs") >= least)).select("video", "team", F.posexplode("probs").alias("class", "v")).groupBy("video", "team", "class").agg(F.sum("v").alias("mass")).where("mass > 0")
    roster = mass.withColumn("rank", F.row_number().over(Window.partitionBy("video", "team").orderBy(F.desc("mass"), "class"))).where(F.col("rank") <= k)
    by = ["video"] if both_teams else ["video", "team"]
    allowed = roster.groupBy(*by).agg(F.array_distinct(F.collect_list("class")).alias("_allowed"))
    every = F.sequence(F.lit(0), F.lit(len(numbers) - 1))
    ready = seen.join(allowed, by, "left").withColumn("_allowed", F.coalesce("_allowed", every))
    voted = weighted_vote(ready, SHOT, "probs", F.col("_allowed"), least).select(*SHOT, "class")
    out = crops.select(*SHOT, "team").distinct().join(voted, SHOT, "left")
    if both_teams:
        only = roster.groupBy("video", "class").agg(F.min("team").alias("_team"), F.countDistinct("team").alias("_n")).where("_n = 1")
        out = out.join(only, ["video", "class"], "left").withColumn("team", F.coalesce("_team", "team"))
    names = F.array(*(F.lit(str(n)) for n in numbers))
    return out.select(*SHOT, "team", F.coalesce(F.get(names, F.col("class").cast("int")), F.lit("?")).alias("number"))


def identity_grid(crops: DataFrame, truth: DataFrame, spans: list[tuple[int, int]], overlaps: list[float], levels: list[float]) -> DataFrame:
    """(before, after, overlap, level, n, right): the number vote for each setting, all settings in one pass.

    crops has (video, shot, release, frame, overlap, probs), truth (video, shot, class). Rows grow by the number of settings.
    """
    settings = F.array(*(F.struct(F.lit(f"{b}/{a}/{o}/{v}").alias("setting"), F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(float(o)).alias("most"), F.lit(float(v)).alias("level")) for b, a in spans for o in overlaps for v in levels))
    rows = crops.select("*", F.explode(settings).alias("_s")).select(*crops.columns, "_s.*")
    near = rows.where(F.col("frame").between(F.col("release") - F.col("before"), F.col("release") + F.col("after")))
    clean = F.col("overlap") <= F.col("most")
    views = near.withColumn("_some", F.max(clean).over(Window.partitionBy("setting", *SHOT))).where(~F.col("_some") | clean)
    sure = views.where(F.array_max("probs") >= F.col("level")).select("setting", *SHOT, F.posexplode("probs").alias("_k", "_v")).groupBy("setting", *SHOT, "_k").agg(F.sum("_v").alias("_m"))
    best = sure.groupBy("setting", *SHOT).agg((-F.max(F.struct("_m", (-F.col("_k")).alias("_k")))["_k"]).alias("guess"))
    asked = truth.select(*SHOT, F.col("class").alias("_want"), F.explode(settings).alias("_s")).select(*SHOT, "_want", "_s.*")
    return asked.join(best, ["setting", *SHOT], "left").groupBy("before", "after", F.col("most").alias("overlap"), "level").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("guess") == F.col("_want"), F.lit(False))).alias("right"))


def shooter_results(pairs: DataFrame, labels: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """(video, event_id, shot, want, got, result) for pairs (video, event_id, shot) of labelled and found shots.

    labels: (video, event_id, status, track); found: (video, shot, track); matched: (video, shot, gid), the true player whose
    box the found track has.
    """
    want = F.when(F.col("status") == "ok", F.col("_want"))
    rows = pairs.join(labels.select("video", "event_id", "status", F.col("track").alias("_want")), ["video", "event_id"], "left").join(found.select(*SHOT, "track"), SHOT, "left").join(matched.select(*SHOT, "gid"), SHOT, "left")
    result = F.when(want.isNull(), "no label").when(F.col("track").isNull(), "no shooter").when(F.col("gid").isNull(), "box not matched").when(F.col("gid") == want, "correct").otherwise("wrong player")
    return rows.select("video", "event_id", "shot", want.alias("want"), F.col("gid").alias("got"), result.alias("result"))


def team_results(pairs: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """(video, n, right, unknown, swapped): teams under the better naming of the two; '?' is neither."""
    known = F.col(guess) != "?"
    same, swap = F.count_if(F.col(truth) == F.col(guess)), F.count_if(known & (F.col(truth) != F.col(guess)))
    return pairs.groupBy("video").agg(F.count("*").alias("n"), F.greatest(same, swap).alias("right"), F.count_if(~known).alias("unknown"), (swap > same).alias("swapped"))


def shot_errors(gt: DataFrame, pred: DataFrame, ends: DataFrame, tolerance: float = 1.0, fps: float = 29.97, tail: int = 45) -> DataFrame:
    """(video, kind, gt_id, pred_id, offset) of missed, extra, right and wrong shots.

    gt and pred have (video, id, at, made), at in seconds; ends (video, frames). True shots of the last `tail` frames are left
    out, as their balls aren't seen to the end.
    """
    inside = gt.join(ends.select("video", "frames"), "video").where(F.col("at") * fps < F.col("frames") - tail).select("video", F.col("id").alias("gt_id"), F.col("at").alias("gt_at"), F.col("made").alias("gt_made"))
    found = pred.select("video", F.col("id").alias("pred_id"), F.col("at").alias("pred_at"), F.col("made").alias("pred_made"))
    pairs = one_to_one(inside, found, ["video"], "gt_id", "pred_id", "gt_at", "pred_at", tolerance).select("video", "gt_id", "pred_id")
    both = pairs.join(inside, ["video", "gt_id"]).join(found, ["video", "pred_id"]).select("video", F.when(F.col("gt_made") == F.col("pred_made"), "right").otherwise("wrong").alias("kind"), "gt_id", "pred_id", (F.col("pred_at") - F.col("gt_at")).alias("offset"))
    none = F.lit(None)
    missed = unmatched(inside, pairs, ["video", "gt_id"]).select("video", F.lit("missed").alias("kind"), "gt_id", none.cast("long").alias("pred_id"), none.cast("double").alias("offset"))
    extra = unmatched(found, pairs, ["video", "pred_id"]).select("video", F.lit("extra").alias("kind"), none.cast("long").alias("gt_id"), "pred_id", none.cast("double").alias("offset"))
    return both.unionByName(missed).unionByName(extra)


def error_summary(errors: DataFrame) -> DataFrame:
    """(video, matched, recall, precision, make_accuracy, median, least and most offset) of shot_errors."""
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    hits = count("right", "wrong")
    return errors.groupBy("video").agg(hits.alias("matched"), ratio(hits, hits + count("missed")).alias("recall"), ratio(hits, hits + count("extra")).alias("precision"), ratio(count("right"), hits).alias("make_accuracy"), F.median("offset").alias("offset"), F.min("offset").alias("least"), F.max("offset").alias("most"))


def review_items(items: DataFrame, players: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items (video, event_id, label_team, candidates: array of (id, dist, n), best first) with flag, decision and label_team_ds.

    players: (video, id, team), an id once; decisions: (video, event_id, decision). A video's team letters are swapped if more
    proposals differ from their label than agree.
    """
    first = F.get(F.col("candidates"), F.lit(0))
    rows = items.withColumn("_id", first["id"]).join(players.select("video", F.col("id").alias("_id"), F.col("team").alias("_team")), ["video", "_id"], "left")
    known = F.col("_team").isNotNull() & F.col("label_team").isin("A", "B")
    over = Window.partitionBy("video")
    swapped = F.sum(F.when(known & (F.col("_team") != F.col("label_team")), 1).when(known, -1).otherwise(0)).over(over) > 0
    named = F.when(~F.col("label_team").isin("A", "B"), None).when(swapped, F.translate("label_team", "AB", "BA")).otherwise(F.col("label_team"))
    rows = rows.withColumn("label_team_ds", named)
    close = F.get(F.col("candidates"), F.lit(1))["dist"] - first["dist"] < 0.1
    reason = F.when(F.coalesce(F.size("candidates"), F.lit(0)) <= 0, "no proposal").when(F.col("label_team_ds") != F.col("_team"), "team differs from shot label").when(close, "close second candidate")
    return rows.withColumn("flag", reason).join(decisions.select("video", "event_id", "decision"), ["video", "event_id"], "left").drop("_id", "_team")


def ball_items(frames: DataFrame, proposals: DataFrame, labels: DataFrame, rims: DataFrame) -> DataFrame:
    """Frames (video, frame) to review, with image name, proposals (image, proposals), label (image, label) and rim."""
    named = frames.withColumn("image", F.format_string("%s_f%05d.jpg", "video", F.col("frame").cast("int")))
    return named.join(proposals.select("image", "proposals"), "image", "left").join(labels.select("image", "label"), "image", "left").join(rims.select("video", "rim"), "video")


def proposed_shooters(shots: DataFrame, near: DataFrame, most: int = 5) -> DataFrame:
    """(video, shot, release, proposal, candidates): the best few candidates of each shot as an array, best first."""
    top = ranked_shooters(near).where(F.col("rank") <= most)
    lists = top.groupBy(*SHOT).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("track").alias("id"), "dist", "n"))).alias("_c"))
    plain = F.transform("_c", lambda c: F.struct(c["id"].alias("id"), c["dist"].alias("dist"), c["n"].alias("n")))
    return shots.select(*SHOT, "release").join(lists, SHOT, "left").select(*SHOT, "release", F.get(F.col("_c"), F.lit(0))["id"].alias("proposal"), F.coalesce(plain, F.array().cast("array<struct<id:int,dist:double,n:bigint>>")).alias("candidates"))


def in_button_order(players: DataFrame, team: str = "team", number: str = "number") -> DataFrame:
    """Players by team, then number; unknown ones last. A list of players is small: the sort is for showing it."""
    return players.orderBy(F.coalesce(team, F.lit("Z")), F.coalesce(number, F.lit(99)))
