"""Tracks of persons: predicted boxes meet a frame's sure detections first and the unsure ones then."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SURE, START, UNSURE = 0.5, 0.6, 0.1  # confidences: of the first pass, of a new track, of the second pass
MEET, MEET_UNSURE, MEET_NEW = 0.2, 0.5, 0.3  # least IoU: first pass, second pass, tracks with one hit so far
KEEP = 30  # frames that an unseen track is kept
AT, SPEED = 1.0 / 20.0, 1.0 / 160.0  # deviations of a box and of its speed in a frame, in box heights
IDS = 100_000  # ids of a piece of a video
FIELDS = ("middle", "speed", "var", "cross", "fast")


class PersonLinker:
    """The tracks of one video: for each, a Kalman filter of constant speed over (centre x, centre y, width over height, height).

    The four numbers don't depend on each other (all noise is diagonal), so a track has four filters of two numbers: place
    and speed, with their variances (var, fast) and covariance (cross), all as arrays over tracks.
    """

    def __init__(self):
        self.id, self.last, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        self.live = np.zeros(0, bool)  # seen in the frame before, or predicted over frames without any detection
        for f in FIELDS:
            setattr(self, f, np.zeros((0, 4)))
        self.made, self.now = 0, None

    def state(self) -> dict:
        """What a stream keeps between batches."""
        return {"tracks": {k: getattr(self, k).tolist() for k in ("id", "last", "hits", "live", *FIELDS)}, "made": self.made, "now": self.now}

    @classmethod
    def of(cls, state: dict) -> PersonLinker:
        new = cls()
        for k, v in state["tracks"].items():
            kind = getattr(new, k)
            setattr(new, k, np.array(v, kind.dtype).reshape(-1, *kind.shape[1:]))
        new.made, new.now = state["made"], state["now"]
        return new

    def _noise(self, height: np.ndarray, at: float, ratio: float) -> np.ndarray:
        """Deviations of the four numbers: shares of the height, but a fixed one for the ratio."""
        out = np.repeat(height[:, None] * at, 4, axis=1)
        out[:, 2] = ratio
        return out

    def _predict(self, frames: int) -> None:
        for _ in range(frames):
            high = np.abs(self.middle[:, 3])
            q, qv = self._noise(high, AT, 1e-2) ** 2, self._noise(high, SPEED, 1e-5) ** 2
            self.middle = self.middle + self.speed
            self.var, self.cross, self.fast = self.var + 2 * self.cross + self.fast + q, self.cross + self.fast, self.fast + qv

    def _update(self, t: np.ndarray, seen: np.ndarray) -> None:
        r = self._noise(np.abs(self.middle[t, 3]), AT, 1e-1) ** 2
        gain, gain_v = self.var[t] / (self.var[t] + r), self.cross[t] / (self.var[t] + r)
        off = seen - self.middle[t]
        self.middle[t] += gain * off
        self.speed[t] += gain_v * off
        self.fast[t] -= gain_v * self.cross[t]
        self.cross[t] *= 1 - gain
        self.var[t] *= 1 - gain

    def _pairs(self, tracks: np.ndarray, boxes: np.ndarray, found: np.ndarray, least: float) -> list[tuple[int, int]]:
        """(track, detection): the highest IoU first, each used once; ties by track, then by detection."""
        if not len(tracks) or not len(found):
            return []
        w = self.middle[tracks, 2] * self.middle[tracks, 3]
        a = np.stack([self.middle[tracks, 0] - w / 2, self.middle[tracks, 1] - self.middle[tracks, 3] / 2, w, self.middle[tracks, 3]], 1)[:, None]
        b = boxes[found][None]
        wide = np.clip(np.minimum(a[..., 0] + a[..., 2], b[..., 0] + b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0, None)
        tall = np.clip(np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0, None)
        iou = wide * tall / (a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - wide * tall)
        rows, cols = np.nonzero(iou >= least)
        out, used, taken = [], set(), set()
        for k in np.lexsort((cols, rows, -iou[rows, cols])):
            i, j = int(rows[k]), int(cols[k])
            if i not in used and j not in taken:
                used.add(i)
                taken.add(j)
                out.append((int(tracks[i]), int(found[j])))
        return out

    def step(self, frame: int, boxes: np.ndarray, conf: np.ndarray) -> np.ndarray:
        """The track of each detection (x, y, w, h) of a frame, or -1. Frames come in rising order.

        1. Tracks are predicted; those unseen for more than KEEP frames end.
        2. Sure detections meet the tracks of two hits or more, seen lately or not.
        3. Unsure ones meet those of these that were seen in the frame before and found nothing: persons half hidden.
        4. Sure ones that are left meet tracks of one hit, which end if they meet none; those left of them start a track.
        """
        if self.now is not None:
            self._predict(frame - self.now)
        self.now = frame
        self._keep(frame - self.last <= KEEP)
        out, seen = np.full(len(conf), -1, np.int64), np.stack([boxes[:, 0] + boxes[:, 2] / 2, boxes[:, 1] + boxes[:, 3] / 2, boxes[:, 2] / boxes[:, 3], boxes[:, 3]], 1)
        known, new = np.flatnonzero(self.hits > 1), np.flatnonzero(self.hits == 1)
        sure, unsure = np.flatnonzero(conf >= SURE), np.flatnonzero((conf >= UNSURE) & (conf < SURE))
        pairs = self._pairs(known, boxes, sure, MEET)
        rest = known[~np.isin(known, [t for t, _ in pairs]) & self.live[known]]
        pairs += self._pairs(rest, boxes, unsure, MEET_UNSURE)
        left = sure[~np.isin(sure, [d for _, d in pairs])]
        pairs += self._pairs(new, boxes, left, MEET_NEW)
        met = np.array(pairs, np.int64).reshape(-1, 2)
        self._update(met[:, 0], seen[met[:, 1]])
        out[met[:, 1]] = self.id[met[:, 0]]
        self.live[:] = False
        self.live[met[:, 0]], self.last[met[:, 0]] = True, frame
        self.hits[met[:, 0]] += 1
        self._keep((self.hits > 1) | (self.last == frame))
        starts = left[~np.isin(left, met[:, 1]) & (conf[left] >= START)]
        n = len(starts)
        out[starts] = self.made + np.arange(n)
        high = seen[starts, 3]
        for k, more in (("id", out[starts]), ("last", np.full(n, frame)), ("hits", np.ones(n, np.int64)), ("live", np.ones(n, bool)), ("middle", seen[starts]), ("speed", np.zeros((n, 4))), ("cross", np.zeros((n, 4))), ("var", self._noise(high, 2 * AT, 1e-2) ** 2), ("fast", self._noise(high, 10 * SPEED, 1e-5) ** 2)):
            setattr(self, k, np.concatenate([getattr(self, k), more]))
        self.made += n
        return out

    def _keep(self, which: np.ndarray) -> None:
        for k in ("id", "last", "hits", "live", *FIELDS):
            setattr(self, k, getattr(self, k)[which])


def linked(linker: PersonLinker, rows: pd.DataFrame, past: int | None = None) -> np.ndarray:
    """The track of each of a video's rows, which are sorted by frame; rows of frames up to past have -1."""
    frames, conf = rows["frame"].to_numpy(), rows["conf"].to_numpy(float)
    boxes, out = rows[["x", "y", "w", "h"]].to_numpy(float), np.full(len(rows), -1, np.int64)
    starts = np.flatnonzero(np.diff(frames, prepend=frames[0] - 1)) if len(frames) else np.zeros(0, np.int64)
    for a, z in zip(starts.tolist(), np.append(starts[1:], len(frames)).tolist()):
        if past is None or frames[a] > past:
            ok = a + np.flatnonzero((boxes[a:z, 2] > 0) & (boxes[a:z, 3] > 0))
            out[ok] = linker.step(int(frames[a]), boxes[ok], conf[ok])
    return out


def person_tracks(detections: DataFrame, piece: int | None = None) -> DataFrame:
    """detections (video, det_seq, frame, x, y, w, h, conf) with track_id, null where a detection belongs to no track.

    Each frame depends on the one before, so a video is one group, dealt over all shuffle partitions. With `piece` a video is
    cut into pieces of so many frames that are tracked side by side: tracks end where a piece ends, and ids begin at IDS
    times the piece's number, so that they stay apart. Boxes without a width or a height belong to no track; a null
    confidence counts as 0; rows without a video or a frame are left out. Further columns go through.
    """
    number = F.floor(F.col("frame") / F.lit(piece or 1)).cast("long") if piece else F.lit(0).cast("long")
    rows = detections.where(F.col("video").isNotNull() & F.col("frame").isNotNull()).withColumn("_piece", number)
    names = detections.columns

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["frame", "det_seq"], kind="stable").reset_index(drop=True)
        sizes = part[["x", "y", "w", "h", "conf"]].astype(float).fillna(0.0)
        track = linked(PersonLinker(), sizes.assign(frame=part["frame"]))
        out = part[names]
        return out.assign(track_id=pd.Series(track + IDS * int(part["_piece"].iloc[0]), dtype="Int64").where(track >= 0))

    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video", "_piece")
    return dealt.groupBy("video", "_piece").applyInPandas(link, detections.select("*", F.lit(None).cast("long").alias("track_id")).schema)
