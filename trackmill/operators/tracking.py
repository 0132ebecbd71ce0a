"""Linking detections to tracks, and the track of a ball from its candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.operators.pieces import medians, numbers, spread, whole, whole_groups
from trackmill.operators.sequences import merge_candidates

# Fixed values of the linker.
MIN_CONF, START_CONF, SIZE_LOW, SIZE_HIGH, ASPECT, MAX_GAP = 0.15, 0.30, 8.0, 100.0, 1.7, 12
GATE, GATE_MISSED, GATE_SPEED, MIN_HITS, SURE_HITS, SURE_CONF = 45.0, 20.0, 1.5, 4, 2, 0.6


def fitting(df: DataFrame) -> DataFrame:
    """(video, frame, det_seq, cx, cy, d, conf) of the detections (video, det_seq, frame, x, y, w, h, conf) of a fitting size and shape."""
    low, high = F.greatest(F.least("w", "h"), F.lit(1e-6)), F.greatest("w", "h")
    fit = df.withColumn("d", (F.col("w") + F.col("h")) / 2.0).where((F.col("conf") >= MIN_CONF) & F.col("d").between(SIZE_LOW, SIZE_HIGH) & (high / low <= ASPECT))
    return fit.select("video", "frame", "det_seq", (F.col("x") + F.col("w") / 2.0).cast("double").alias("cx"), (F.col("y") + F.col("h") / 2.0).cast("double").alias("cy"), F.col("d").cast("double").alias("d"), F.col("conf").cast("double").alias("conf"))


def candidates(df: DataFrame) -> DataFrame:
    """Fitting detections, merged within each frame; a merged one's det_seq is that of the one that came first, so that its turn
    stays the same."""
    return merge_candidates(fitting(df), ["video", "frame"], "det_seq", "cx", "cy", "d", "conf", slot="_slot").withColumn("det_seq", F.col("_slot")).drop("_slot")


class Linker:
    """Tracks of one video, frame by frame: the state that a stream keeps between batches."""

    def __init__(self):
        self.open: list[dict] = []
        self.made = 0

    def step(self, frame: int, x: np.ndarray, y: np.ndarray, conf: np.ndarray) -> list[tuple[int, int]]:
        """(track, candidate) for each candidate that joins or starts a track."""
        self.open = [t for t in self.open if frame - t["last"] <= MAX_GAP]
        out, free = [], np.ones(len(x), bool)
        if self.open and len(x):
            gap = np.array([frame - t["last"] for t in self.open], float)
            at, v = np.array([t["at"] for t in self.open]), np.array([t["v"] for t in self.open])
            ahead = at + v * gap[:, None]
            gate = GATE + GATE_MISSED * (gap - 1) + GATE_SPEED * np.hypot(v[:, 0], v[:, 1]) * gap
            far = np.hypot(x[None] - ahead[:, :1], y[None] - ahead[:, 1:])
            rows, cols = np.nonzero(far < gate[:, None])
            cost = far[rows, cols] / gate[rows] - 0.3 * conf[cols]
            used = np.zeros(len(self.open), bool)
            for k in np.lexsort((cols, rows, cost)):
                i, j = rows[k], cols[k]
                if used[i] or not free[j]:
                    continue
                used[i], free[j] = True, False
                t, now = self.open[i], np.array([x[j], y[j]])
                speed = (now - t["at"]) / gap[i]
                t |= {"v": speed if t["hits"] == 1 else 0.5 * t["v"] + 0.5 * speed, "at": now, "last": frame, "hits": t["hits"] + 1}
                out.append((t["id"], int(j)))
        for j in np.flatnonzero(free & (conf >= START_CONF)):
            self.open.append({"id": self.made, "at": np.array([x[j], y[j]]), "v": np.zeros(2), "last": frame, "hits": 1})
            out.append((self.made, int(j)))
            self.made += 1
        return out


def merged_rows(group: np.ndarray, x: np.ndarray, y: np.ndarray, d: np.ndarray, conf: np.ndarray, share: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """(row, first): merge_candidates of all groups (frames; their rows follow each other in turn) side by side: the rows that are
    left, in the order of their places, and the row that took each place first."""
    begins = np.flatnonzero(np.append(True, np.diff(group) != 0)[: len(group)])
    sizes = np.diff(np.append(begins, len(group)))
    place, took = np.full(len(group), -1), np.arange(len(group))  # at a group's begin and the number of a place: who has it
    level = np.frexp(sizes.astype(float))[1]
    for k in np.unique(level):  # groups of like sizes, so that the tables below have few gaps
        own, size = begins[level == k], sizes[level == k]
        who = np.full((len(own), int(size.max())), -1)
        many = np.zeros(len(own), np.int64)
        for j in range(who.shape[1]):
            g = np.flatnonzero(size > j)
            row, wide = own[g] + j, max(int(many[g].max()), 1)
            kept = who[g, :wide]
            close = (np.arange(wide) < many[g, None]) & (np.hypot(x[kept] - x[row, None], y[kept] - y[row, None]) < share * np.maximum(d[kept], d[row, None]))
            at = np.where(close.any(1), close.argmax(1), many[g])
            new = at == many[g]
            put = new | (conf[row] > conf[who[g, np.minimum(at, wide - 1)]])
            took[own[g[new]] + at[new]] = row[new]
            who[g[put], at[put]] = row[put]
            many[g[new]] += 1
        i, j = np.nonzero(who >= 0)
        place[own[i] + j] = who[i, j]
    at = np.flatnonzero(place >= 0)
    return place[at], took[at]


def linked_rows(video: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray, conf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(track, row): what a Linker for each video gives over its frames, videos side by side: step k is each one's k-th frame.
    Rows are sorted by video (from 0 on) and frame."""
    new = np.append(True, (np.diff(video) != 0) | (np.diff(frame) != 0))[: len(video)]
    begins = np.flatnonzero(new)
    ends, owner = np.append(begins[1:], len(video)), video[begins]
    turn = np.arange(len(begins)) - np.searchsorted(owner, owner)
    steps = np.split(np.argsort(turn, kind="stable"), np.cumsum(np.bincount(turn))[:-1]) if len(begins) else []
    n = int(video[-1]) + 1 if len(video) else 0
    made, low, high, now = (np.zeros(n, np.int64) for _ in range(4))
    ints, reals = np.zeros((4, 0), np.int64), np.zeros((4, 0))  # open tracks, by video and number: video, number, last frame, hits; place and speed
    tracks, rows, free, first_c = [], [], np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    for step in steps:
        v = owner[step]
        now[:], low[:], high[:] = -1 << 60, 0, 0
        now[v], low[v], high[v] = frame[begins[step]], begins[step], ends[step]
        alive = (now[ints[0]] > -1 << 60) & (now[ints[0]] - ints[2] <= MAX_GAP)
        ints, reals = ints[:, alive], reals[:, alive]
        gap = (now[ints[0]] - ints[2]).astype(float)
        ahead = reals[:2] + reals[2:] * gap
        gate = GATE + GATE_MISSED * (gap - 1) + GATE_SPEED * np.hypot(reals[2], reals[3]) * gap
        t, c = spread(low[ints[0]], high[ints[0]])
        far = np.hypot(x[c] - ahead[0, t], y[c] - ahead[1, t])
        near = far < gate[t]
        t, c, far = t[near], c[near], far[near]
        order = np.lexsort((c, t, far / gate[t] - 0.3 * conf[c]))
        t, c = t[order], c[order]
        spot = spread(begins[step], ends[step])[1]  # this step's candidates
        free[spot] = True
        busy = np.zeros(ints.shape[1], bool)
        first_t = np.zeros(ints.shape[1], np.int64)
        while len(t):  # the best pair of both its track and its candidate is taken, and so on
            k = np.arange(len(t))[::-1]
            first_t[t[::-1]], first_c[c[::-1]] = k, k
            best = (first_t[t] == k[::-1]) & (first_c[c] == k[::-1])
            i, j = t[best], c[best]
            speed = (np.stack([x[j], y[j]]) - reals[:2, i]) / gap[i]
            reals[2:, i] = np.where(ints[3, i] == 1, speed, 0.5 * reals[2:, i] + 0.5 * speed)
            reals[0, i], reals[1, i] = x[j], y[j]
            ints[2, i] = now[ints[0, i]]
            ints[3, i] += 1
            busy[i], free[j] = True, False
            tracks.append(ints[:2, i])
            rows.append(j)
            left = ~busy[t] & free[c]
            t, c = t[left], c[left]
        j = spot[free[spot] & (conf[spot] >= START_CONF)]
        j.sort()
        free[spot] = False
        of = video[j]
        number = made[of] + np.arange(len(j)) - np.searchsorted(of, of)
        made += np.bincount(of, minlength=n)
        tracks.append(np.stack([of, number]))
        rows.append(j)
        ints = np.concatenate([ints, np.stack([of, number, now[of], np.ones(len(j), np.int64)])], axis=1)
        reals = np.concatenate([reals, np.stack([x[j], y[j], np.zeros(len(j)), np.zeros(len(j))])], axis=1)
        order = np.lexsort((ints[1], ints[0]))
        ints, reals = ints[:, order], reals[:, order]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(tracks, axis=1)[1], np.concatenate(rows)


FEW = 8  # videos in a task's rows up to which they are followed one by one


def _linked(video: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray, conf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(track, row) of the tracks of all videos that have enough hits, sorted by video, track and frame."""
    if len(video) and video[-1] >= FEW:
        track, row = linked_rows(video, frame, x, y, conf)
    else:
        out, now, linker = [], -1, Linker()
        begins = np.flatnonzero(np.append(True, (np.diff(video) != 0) | (np.diff(frame) != 0))[: len(video)])
        for a, z in zip(begins.tolist(), np.append(begins[1:], len(video)).tolist()):
            if video[a] != now:
                now, linker = video[a], Linker()
            out += [(track, a + j) for track, j in linker.step(int(frame[a]), x[a:z], y[a:z], conf[a:z])]
        track, row = np.array(out, np.int64).reshape(-1, 2).T
    order = np.lexsort((frame[row], track, video[row]))
    track, row = track[order], row[order]
    new = np.append(True, (np.diff(video[row]) != 0) | (np.diff(track) != 0))[: len(row)]
    begins = np.flatnonzero(new)
    hits = np.diff(np.append(begins, len(row)))
    most = np.maximum.reduceat(conf[row], begins) if len(row) else conf[row]
    good = ((hits >= MIN_HITS) | ((hits >= SURE_HITS) & (most >= SURE_CONF)))[np.cumsum(new) - 1]
    return track[good], row[good]


def _in_videos(rows: DataFrame, merge: bool, work, schema: str) -> DataFrame:
    """work(rows, video, track, columns): the linked rows of rows (video, frame, det_seq, cx, cy, d, conf), whole videos of a task at a time."""

    def run(batches):
        for t, video in whole_groups(batches, ["video"]):
            frame = whole(t, "frame")
            columns = [numbers(t, c) for c in ("cx", "cy", "d", "conf")]
            at = np.arange(len(t))
            if merge:
                at = merged_rows(np.cumsum(np.append(0, (np.diff(video) != 0) | (np.diff(frame) != 0)))[: len(t)], *columns)[0]
            video, frame, columns = video[at], frame[at], [c[at] for c in columns]
            track, row = _linked(video, frame, columns[0], columns[1], columns[3])
            yield from work(t.select(["video"]).take(pa.array(at[row])), video[row], frame[row], track, [c[row] for c in columns])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "video").sortWithinPartitions("video", "frame", "det_seq").mapInArrow(run, f"video {rows.schema['video'].dataType.simpleString()}, {schema}")


def _batches(rows: pa.Table, more: dict[str, pa.Array]) -> list[pa.RecordBatch]:
    for name, column in more.items():
        rows = rows.append_column(name, column)
    return rows.combine_chunks().to_batches(max_chunksize=1 << 16)


def _tracks(rows: DataFrame, merge: bool) -> DataFrame:
    def work(own, video, frame, track, columns):
        x, y, d, conf = columns
        return _batches(own, {"track": pa.array(track), "frame": pa.array(frame.astype(np.int32)), "x": pa.array(x), "y": pa.array(y), "size": pa.array(d), "conf": pa.array(conf)})

    return _in_videos(rows, merge, work, "track long, frame int, x double, y double, size double, conf double")


def link_tracks(cands: DataFrame) -> DataFrame:
    """(video, track, frame, x, y, size, conf) of tracks with enough hits.

    Each frame depends on the one before, so a video's rows lie in one task; videos are short, and a task follows many side by
    side. They are dealt over all shuffle partitions, as adaptive execution would put them together by bytes, not by work.
    """
    return _tracks(cands, False)


def tracks_of(detections: DataFrame) -> DataFrame:
    """link_tracks(candidates(detections)) without a shuffle between them."""
    return _tracks(fitting(detections), True)


def _gaps(key: np.ndarray, frame: np.ndarray, values: list[np.ndarray], most: int = 12) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row, frame, values): sequences.fill_gaps of sorted rows; the row is that before the gap."""
    n = len(key)
    same = np.append(key[1:] == key[:-1], False)[:n]
    wide = np.where(same, np.append(frame[1:], 0)[:n] - frame, 0)
    gap = np.flatnonzero((wide >= 2) & (wide <= most))
    middle = (frame[gap] + frame[gap + 1]) / 2.0
    s, m, many = [np.zeros(len(gap)) for _ in range(5)], [[np.zeros(len(gap)) for _ in range(3)] for _ in values], np.zeros(len(gap), np.int64)
    for d in range(-3, 5):
        at = np.clip(gap + d, 0, n - 1)
        there = (gap + d >= 0) & (gap + d < n) & (key[at] == key[gap])
        t = frame[at] - middle
        many += there
        for k in range(5):
            s[k] += np.where(there, t**k, 0.0)
        for own, v in zip(m, values):
            for k in range(3):
                own[k] += np.where(there, v[at] * t**k, 0.0)
    i, new = spread(frame[gap] + 1, frame[gap + 1])
    u, out = new - middle[i], []
    with np.errstate(divide="ignore", invalid="ignore"):
        for m0, m1, m2 in m:
            det2 = s[0] * s[2] - s[1] * s[1]
            line = ((m0 * s[2] - m1 * s[1]) / det2, (m1 * s[0] - m0 * s[1]) / det2, np.zeros(len(gap)))
            det3 = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] * s[2])
            c0 = m0 * (s[2] * s[4] - s[3] * s[3]) - s[1] * (m1 * s[4] - s[3] * m2) + s[2] * (m1 * s[3] - s[2] * m2)
            c1 = s[0] * (m1 * s[4] - s[3] * m2) - m0 * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * m2 - m1 * s[2])
            c2 = s[0] * (s[2] * m2 - m1 * s[3]) - s[1] * (s[1] * m2 - m1 * s[2]) + m0 * (s[1] * s[3] - s[2] * s[2])
            a, b, c = (np.where(many >= 4, q / det3, k)[i] for q, k in zip((c0, c1, c2), line))
            out.append(a + b * u + c * u * u)
    return gap[i], new, out


def ball_track(detections: DataFrame) -> DataFrame:
    """(video, frame, x, y, size, conf, track, state): detected rows (state 1) and short gaps filled (2); where tracks
    meet in a frame, the one with more confidence in all wins, then the earlier one. All of it is worked out where a video's
    detections are linked, so they are shuffled once."""

    def work(own, video, frame, track, columns):
        x, y, d, conf = columns
        new = np.append(True, (np.diff(video) != 0) | (np.diff(track) != 0))[: len(track)]
        key = np.cumsum(new) - 1
        n = int(key[-1]) + 1 if len(key) else 0
        score, middle = np.bincount(key, conf, n), medians(key, d, n)
        before, at, (gx, gy) = _gaps(key, frame, [x, y])
        row = np.concatenate([np.arange(len(key)), before])
        k, f = key[row], np.concatenate([frame, at])
        order = np.lexsort((track[row], -score[k], f, video[row]))
        head = order[np.append(True, (np.diff(video[row][order]) != 0) | (np.diff(f[order]) != 0))[: len(order)]]
        seen, more = len(key), len(before)
        pick = lambda a, b: np.concatenate([a, b])[head]
        return _batches(own.take(pa.array(row[head])), {
            "frame": pa.array(f[head].astype(np.int32)), "x": pa.array(pick(x, gx)), "y": pa.array(pick(y, gy)), "size": pa.array(pick(d, middle[key[before]])), "conf": pa.array(pick(conf, np.zeros(more))),
            "track": pa.array(track[row[head]]), "state": pa.array(pick(np.full(seen, 1, np.int32), np.full(more, 2, np.int32))),
        })

    return _in_videos(fitting(detections), True, work, "frame int, x double, y double, size double, conf double, track long, state int")
