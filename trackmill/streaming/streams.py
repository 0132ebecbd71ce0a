"""Live forms of the operators; they have no batch state beyond what watermarks allow."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackmill.operators.persons import PersonLinker, linked
from trackmill.operators.tracking import Linker


def live_statistics(events: DataFrame, at: str, team: str, made: str, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Attempts and makes of each team in tumbling windows of event time, with a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), team).agg(F.count("*").alias("attempts"), F.count_if(F.col(made)).alias("made"))


def live_matches(gt: DataFrame, pred: DataFrame, on: str, gt_at: str, pred_at: str, tolerance: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Pairs of two streams within the tolerance; state is kept as long as the watermark allows."""
    a, b = gt.withWatermark(gt_at, late), pred.withWatermark(pred_at, late).withColumnRenamed(on, "_on")
    near = (F.col(on) == F.col("_on")) & F.col(pred_at).between(F.col(gt_at) - F.expr(f"INTERVAL {tolerance}"), F.col(gt_at) + F.expr(f"INTERVAL {tolerance}"))
    return a.join(b, near).drop("_on")


def live_tracks(cands: DataFrame) -> DataFrame:
    """(video, track, frame, x, y, size, conf) for each candidate that joins or starts a track, as its batch comes.

    cands is as link_tracks takes it. A video's state is its open tracks, those of the last few frames. Its frames must come
    in order over the batches, and a frame whole in one batch; a row of a frame that is past has track -1. Tracks of too few
    hits are in it, as a stream can't know them beforehand.
    """

    def link(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        linker, past = Linker(), -1
        if state.exists:
            opened, linker.made, past = json.loads(state.get[0])
            linker.open = [t | {"at": np.array(t["at"]), "v": np.array(t["v"])} for t in opened]
        rows, out = pd.concat(list(parts)).sort_values(["frame", "det_seq"], kind="stable"), []
        for frame, part in rows.groupby("frame", sort=True):
            cx, cy, d, conf = (part[c].to_numpy() for c in ("cx", "cy", "d", "conf"))
            pairs = linker.step(int(frame), cx, cy, conf) if frame > past else [(-1, j) for j in range(len(part))]
            past = max(past, int(frame))
            out += [(key[0], track, int(frame), cx[j], cy[j], d[j], conf[j]) for track, j in pairs]
        state.update((json.dumps([[t | {"at": t["at"].tolist(), "v": t["v"].tolist()} for t in linker.open], linker.made, past]),))
        yield pd.DataFrame(out, columns=["video", "track", "frame", "x", "y", "size", "conf"])

    schema = "video string, track long, frame int, x double, y double, size double, conf double"
    return cands.groupBy("video").applyInPandasWithState(link, schema, "open string", "append", GroupStateTimeout.NoTimeout)


class _Persons(StatefulProcessor):
    """A video's person tracks, kept as JSON between batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("tracks", "tracks string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        linker = PersonLinker.of(json.loads(self.held.get()[0])) if self.held.exists() else PersonLinker()
        past = -1 if linker.now is None else linker.now
        part = pd.concat(list(rows)).sort_values(["frame", "det_seq"], kind="stable").reset_index(drop=True)
        track = linked(linker, part, past)
        self.held.update((json.dumps(linker.state()),))
        yield part[["video", "frame", "det_seq"]].assign(track_id=track)

    def close(self) -> None:
        pass


def live_person_tracks(detections: DataFrame) -> DataFrame:
    """(video, frame, det_seq, track_id) of each detection as its batch comes, -1 without a track; detections are as
    person_tracks takes them. A video's state is its open tracks. Its frames must come in order over the batches, and a frame
    whole in one batch; a row of a frame that is past has -1. Needs the RocksDB state store provider."""
    schema = "video string, frame long, det_seq long, track_id long"
    rows = detections.select(F.col("video").cast("string").alias("video"), F.col("frame").cast("long").alias("frame"), F.col("det_seq").cast("long").alias("det_seq"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("x", "y", "w", "h", "conf")))
    return rows.groupBy("video").transformWithStateInPandas(_Persons(), schema, "append", "none")
