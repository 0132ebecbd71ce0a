"""Person tracks against a plain loop of matrices, on crossing persons, in pieces and live."""

import numpy as np
import pytest

from trackmill.operators import persons
from trackmill.streaming import streams


def crossing(seed, frames=90):
    """(truth, video, det_seq, frame, x, y, w, h, conf): two persons who walk through each other, the one behind half hidden
    there; a third one leaves and comes back; boxes that nobody is."""
    r, rows = np.random.default_rng(seed), []
    for f in range(frames):
        people = [(0, 100 + 6 * f, 300 + f, 0.9), (1, 640 - 6 * f, 330 + f, 0.3 if 35 <= f <= 52 else 0.85)]
        if f < 30 or f > 45:
            people.append((2, 1000 + 4 * f, 500 - f, 0.8))
        if f % 10 == 3:
            people.append((-1, 50 + 17 * f, 900, 0.05))
        if f % 25 == 7:
            people.append((-1, 1500, 40 + f, 0.7))
        for k in r.permutation(len(people)).tolist():
            who, x, y, c = people[k]
            rows.append((who, f"v{seed % 2}", len(rows), f, float(x + r.normal()), float(y + r.normal()), 60.0 + r.normal(), 160.0 + r.normal(), c))
    return rows


def plain_tracks(rows):
    """The same rules with one 8 by 8 filter a track, detection by detection."""
    move, look = np.eye(8), np.eye(4, 8)
    move[:4, 4:] = np.eye(4)
    tracks, made, out, now = [], 0, {}, None
    devs = lambda h, at, ratio: [at * h, at * h, ratio, at * h]

    def iou(t, b):
        x, y, a, h = t["m"][:4]
        w = a * h
        x, y = x - w / 2, y - h / 2
        s = max(0, min(x + w, b[0] + b[2]) - max(x, b[0])) * max(0, min(y + h, b[1] + b[3]) - max(y, b[1]))
        return s / (w * h + b[2] * b[3] - s)

    def meet(some, found, least):
        pairs = sorted((-iou(t, d[4:8]), tracks.index(t), found.index(d), t["id"]) for t in some for d in found if iou(t, d[4:8]) >= least)
        got, busy = [], set()
        for _, i, j, _ in pairs:
            if ("t", i) not in busy and ("d", j) not in busy:
                busy |= {("t", i), ("d", j)}
                got.append((tracks[i], found[j]))
        return got

    for frame in sorted({r[3] for r in rows}):
        for _ in range(0 if now is None else frame - now):
            for t in tracks:
                h = abs(t["m"][3])
                t["m"], t["p"] = move @ t["m"], move @ t["p"] @ move.T + np.diag(np.square(devs(h, 1 / 20, 1e-2) + devs(h, 1 / 160, 1e-5)))
        now = frame
        tracks = [t for t in tracks if frame - t["last"] <= persons.KEEP]
        here = [r for r in rows if r[3] == frame]
        sure, unsure = [r for r in here if r[8] >= persons.SURE], [r for r in here if persons.UNSURE <= r[8] < persons.SURE]
        pairs = meet([t for t in tracks if t["hits"] > 1], sure, persons.MEET)
        had = [t["id"] for t, _ in pairs]
        pairs += meet([t for t in tracks if t["hits"] > 1 and t["live"] and t["id"] not in had], unsure, persons.MEET_UNSURE)
        left = [d for d in sure if d not in [x for _, x in pairs]]
        pairs += meet([t for t in tracks if t["hits"] == 1], left, persons.MEET_NEW)
        for t in tracks:
            t["live"] = False
        for t, d in pairs:
            x, y, w, h = d[4:8]
            z = np.array([x + w / 2, y + h / 2, w / h, h])
            gain = t["p"] @ look.T @ np.linalg.inv(look @ t["p"] @ look.T + np.diag(np.square(devs(abs(t["m"][3]), 1 / 20, 1e-1))))
            t |= {"m": t["m"] + gain @ (z - look @ t["m"]), "p": t["p"] - gain @ look @ t["p"], "live": True, "last": frame, "hits": t["hits"] + 1}
            out[d[1], d[2]] = t["id"]
        tracks = [t for t in tracks if t["hits"] > 1 or t["last"] == frame]
        for d in left:
            if (d[1], d[2]) not in out and d[8] >= persons.START:
                x, y, w, h = d[4:8]
                tracks.append({"id": made, "m": np.array([x + w / 2, y + h / 2, w / h, h, 0, 0, 0, 0]), "p": np.diag(np.square(devs(h, 2 / 20, 1e-2) + devs(h, 10 / 160, 1e-5))), "live": True, "last": frame, "hits": 1})
                out[d[1], d[2]] = made
                made += 1
    return {(r[1], r[2]): out.get((r[1], r[2])) for r in rows}


SCHEMA = "truth int, video string, det_seq long, frame int, x double, y double, w double, h double, conf double"


@pytest.mark.parametrize("seed", range(4))
def test_crossing_persons(spark, seed):
    rows = crossing(seed)
    found = persons.person_tracks(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {(r.video, r.det_seq): r.track_id for r in found} == plain_tracks(rows)
    for who in range(3):  # everyone keeps one id, through the crossing and the absence
        assert len({r.track_id for r in found if r.truth == who}) == 1
    assert len({r.track_id for r in found if r.truth >= 0}) == 3
    assert all(r.track_id is None for r in found if r.conf < persons.UNSURE)


def test_ids_by_video_and_piece(spark):
    rows = crossing(0) + crossing(1)
    found = persons.person_tracks(spark.createDataFrame(rows, SCHEMA), piece=40).collect()
    for video in ("v0", "v1"):
        for k in range(3):
            own = [r for r in rows if r[1] == video and r[3] // 40 == k]
            want = {a: None if i is None else i + k * persons.IDS for a, i in plain_tracks(own).items()}
            assert {(r.video, r.det_seq): r.track_id for r in found if r.video == video and r.frame // 40 == k} == want


def test_odd_rows(spark):
    rows = [(0, None, 1, 3, 0.0, 0.0, 1.0, 1.0, 0.9), (0, "v", 1, None, 0.0, 0.0, 1.0, 1.0, 0.9), (0, "v", 2, 3, 0.0, 0.0, 0.0, 5.0, 0.9), (0, "v", 3, 3, 0.0, 0.0, 9.0, 9.0, None), (0, "v", 4, 3, 5.0, 5.0, 9.0, 9.0, 0.9), (0, "v", 4, 3, 5.0, 5.0, 9.0, 9.0, 0.9)]
    found = persons.person_tracks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.det_seq, -1 if r.track_id is None else r.track_id) for r in found) == [(2, -1), (3, -1), (4, 0), (4, 1)]
    assert persons.person_tracks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_live_persons_equal_those_of_a_batch(spark, tmp_path):
    rows = crossing(2) + crossing(3)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    seen = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for k in range(3):
        df.where(f"frame between {30 * k} and {30 * k + 29}").write.mode("append").parquet(str(tmp_path / "in"))
        query = streams.live_person_tracks(seen).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    found = {(r.video, r.det_seq): None if r.track_id < 0 else r.track_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {**plain_tracks([r for r in rows if r[1] == "v0"]), **plain_tracks([r for r in rows if r[1] == "v1"])}
