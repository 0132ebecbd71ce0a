"""Rows of several tables that belong to the same stretch of a video, side by side in a task, as numpy columns.

For questions whose pairs are many times their rows (a shot meets each player in dozens of frames): pairs are made and summed
up within a task, so that only the tables' own rows are shuffled, once. A stretch has PIECE frames and what reaches over its
ends, so a long video lies on many of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 4096  # frames of a stretch
ROWS = 1 << 17  # rows that are worked on at once, and those that complete a stretch
NOWHERE = -(1 << 40)  # the frame of rows without one


def in_pieces(asking: DataFrame, others: dict[str, DataFrame], before: int, after: int, work: Callable[[pa.Table, dict[str, pa.Table]], Iterator[pa.RecordBatch] | list[pa.RecordBatch]], schema: str, piece: int = PIECE) -> DataFrame:
    """work(rows, {name: rows}) over whole stretches of videos, many at once.

    asking has (video, frame, ...), each of the others too; rows of asking meet those of others that are at most `before` frames
    earlier and `after` later: they are all in the same call, with the same number in the column `code` (a frame of the
    asking rows that is null is NOWHERE). Columns of one name have one type. Rows of others without a video or a frame are left out.
    """
    parts = [asking.withColumns({"_kind": F.lit(0), "_piece": F.coalesce(F.floor(F.col("frame") / piece), F.lit(0)).cast("long"), "frame": F.coalesce(F.col("frame").cast("long"), F.lit(NOWHERE))})]
    for k, df in enumerate(others.values(), 1):
        ends = [F.floor((F.col("frame") + d) / piece).cast("long") for d in (-after, before)]
        parts.append(df.where("video is not null and frame is not null").withColumns({"_kind": F.lit(k), "_piece": F.explode(F.sequence(*ends)), "frame": F.col("frame").cast("long")}))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    names, keys = [p.columns for p in parts], list(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables(t: pa.Table, code: np.ndarray):
            kind = t.column("_kind").to_numpy()
            own = []
            for k, columns in enumerate(names):
                at = np.flatnonzero(kind == k)
                own.append(t.select([c for c in columns if c[0] != "_"]).take(pa.array(at)).append_column("code", pa.array(code[at])))
            return work(own[0], dict(zip(keys, own[1:]))) if len(own[0]) else ()

        for t, code in whole_groups(batches, ["video", "_piece"]):
            yield from tables(t, code)

    n = int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "video", "_piece").sortWithinPartitions("video", "_piece").mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, number of each row's group) of about ROWS sorted rows at a time, cut only between groups."""
    held: list[pa.RecordBatch] = []
    rows, limit = 0, ROWS
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= limit:
            t = pa.Table.from_batches(held).combine_chunks()
            code = _group_numbers(t, by)
            cut = int(np.searchsorted(code, code[-1]))
            if cut:
                yield t.slice(0, cut), code[:cut]
            held, rows = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
            limit = max(ROWS, 2 * rows)
    if rows:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _group_numbers(t, by)


def _group_numbers(t: pa.Table, by: list[str]) -> np.ndarray:
    """The number of each row's group, from 0 on, of sorted rows."""
    new = np.zeros(len(t), bool)
    for name in by:
        c = t.column(name).combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), True)
        new[1:] |= pc.and_not(differ, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def numbers(t: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, nulls as NaN."""
    return t.column(name).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)


def whole(t: pa.Table, name: str, none: int = -1) -> np.ndarray:
    """A column of integers, nulls as `none`."""
    return pc.fill_null(t.column(name).combine_chunks().cast(pa.int64()), none).to_numpy(zero_copy_only=False)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): for each i all j in [low[i], high[i])."""
    many = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(low)), many)
    return i, np.arange(len(i)) + np.repeat(low - np.cumsum(many) + many, many)


class Sorted:
    """Rows in the order of (code, track, frame), or of (code, frame), to be found by them. Equal ones keep no order."""

    def __init__(self, code: np.ndarray, frame: np.ndarray, track: np.ndarray | None = None):
        self.base, self.wide = (int(frame.min()), int(frame.max() - frame.min()) + 1) if len(frame) else (0, 1)
        self.tracks = None
        if track is not None:
            self.tracks = np.unique(track)
            code = code * len(self.tracks) + np.searchsorted(self.tracks, track)
        key = code * self.wide + (frame - self.base)
        self.order = np.argsort(key, kind="stable")
        self.key, self.frame = key[self.order], frame[self.order]

    def between(self, code: np.ndarray, first: np.ndarray, last: np.ndarray, track: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the sorted rows with each code (and track) whose frames are in [first, last]."""
        none = (last < self.base) | (first >= self.base + self.wide) | (first > last)
        if self.tracks is not None:
            place = np.minimum(np.searchsorted(self.tracks, track), max(len(self.tracks) - 1, 0))
            none |= (self.tracks[place] != track) if len(self.tracks) else True
            code = code * len(self.tracks) + place
        low = np.searchsorted(self.key, code * self.wide + np.clip(first - self.base, 0, self.wide - 1))
        high = np.searchsorted(self.key, code * self.wide + np.clip(last - self.base, 0, self.wide - 1), "right")
        return low, np.where(none, low, high)

    def nearest(self, code: np.ndarray, at: np.ndarray, reach: int, track: np.ndarray) -> np.ndarray:
        """The row (of those before sorting) whose frame is nearest, the earlier of two; -1 without one within reach."""
        low, high = self.between(code, at - reach, at, track)
        found = np.where(high > low, high - 1, -1)
        low, high = self.between(code, at, at + reach, track)
        later = np.where(high > low, low, -1)
        frame = np.append(self.frame, 0)
        better = (later >= 0) & ((found < 0) | (frame[later] - at < at - frame[found]))
        found = np.where(better, later, found)
        return np.where(found >= 0, np.append(self.order, -1)[found], -1)


def medians(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The median of each of n groups' values that aren't NaN; NaN without any."""
    known = ~np.isnan(value)
    group, value = group[known], value[known]
    value = value[np.lexsort((value, group))]
    many = np.bincount(group, minlength=n)
    begin = np.cumsum(many) - many
    out, some = np.full(n, np.nan), many > 0
    low, high = value[(begin + (many - 1) // 2)[some]], value[(begin + many // 2)[some]]
    out[some] = low + (high - low) * 0.5
    return out


def extremes(group: np.ndarray, value: np.ndarray, n: int, most: bool = False) -> np.ndarray:
    """The least (or the largest) of each of n groups' values that aren't NaN; NaN without any."""
    out = np.full(n, np.nan)
    (np.fmax if most else np.fmin).at(out, group, value)
    return out
