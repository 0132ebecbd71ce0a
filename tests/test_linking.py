"""Videos followed side by side against one Linker each, and merged candidates against the fold over columns."""

import numpy as np
from pyspark.sql import functions as F

from trackmill.operators import tracking


def scene(seed, videos):
    r = np.random.default_rng(seed)
    rows = []
    for v in range(videos):
        for f in range(0, 60, 1 + v % 3):
            for k in range(int(r.integers(0, 6))):
                rows.append((v, len(rows), f, float(r.integers(0, 120)), float(r.integers(0, 90)), float(r.integers(6, 30)), float(r.integers(6, 30)), float(r.integers(0, 64)) / 64))
    return rows


def test_side_by_side(spark):
    df = spark.createDataFrame(scene(4, 30), "video int, det_seq long, frame int, x double, y double, w double, h double, conf double")
    cands = tracking.candidates(df)
    want = []
    for v, rows in cands.orderBy("video", "frame", "det_seq").toPandas().groupby("video"):
        linker, own = tracking.Linker(), []
        for f, part in rows.groupby("frame"):
            x, y, c = (part[k].to_numpy() for k in ("cx", "cy", "conf"))
            own += [(v, t, f, x[j], y[j], part["d"].to_numpy()[j], c[j]) for t, j in linker.step(int(f), x, y, c)]
        for t in {o[1] for o in own}:
            hits = [o for o in own if o[1] == t]
            if len(hits) >= 4 or len(hits) >= 2 and max(o[-1] for o in hits) >= 0.6:
                want += hits
    got = tracking.tracks_of(df)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) == sorted(tuple(r) for r in tracking.link_tracks(cands).collect()) and len(want) > 500
    few = sorted(tuple(r) for r in tracking.tracks_of(df.where("video < 3")).collect())
    assert few == sorted(o for o in want if o[0] < 3)


def test_detections_are_shuffled_once(spark):
    df = spark.createDataFrame(scene(5, 9), "video int, det_seq long, frame int, x double, y double, w double, h double, conf double")
    found = tracking.ball_track(df)
    assert found.count() > 100 and found.groupBy("video", "frame").count().where(F.col("count") > 1).count() == 0
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
