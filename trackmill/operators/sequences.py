"""Ordered rows: islands, windows around a row, folds, greedy suppression and gap filling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators import choices


def rising_segments(df: DataFrame, by: list[str], frame: str, y: str, gap: int = 3, least: float = 0.5, down: bool = True) -> DataFrame:
    """(by, start, end, n, y_start, y_end): maximal runs of rows, each at most gap + 1 frames after the last and better
    by more than `least` (smaller with `down`). A run begins with the row before its first step."""
    w = Window.partitionBy(*by).orderBy(frame)
    step = (F.lag(y).over(w) - F.col(y)) if down else (F.col(y) - F.lag(y).over(w))
    goes_on = F.coalesce((F.col(frame) - F.lag(frame).over(w) <= gap + 1) & (step > least), F.lit(False))
    rows = df.where(F.col(y).isNotNull()).withColumn("_on", goes_on).withColumn("_run", F.sum((~F.col("_on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*by, "_run").agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("n"), F.min_by(y, frame).alias("y_start"), F.max_by(y, frame).alias("y_end"))
    return runs.where("n > 1").drop("_run")


def speed(df: DataFrame, events: DataFrame, on: list[str], at: str, frame: str, value: str, before: int, after: int) -> DataFrame:
    """For each event the mean speed between the first and last row in [at - before, at + after]; null for fewer than two."""
    from trackmill.operators.matching import band_join

    near = band_join(events.select(*on, at), df.select(*on, frame, value), on, at, frame, before, after)
    ends = near.groupBy(*on, at).agg(F.min(F.struct(frame, value)).alias("a"), F.max(F.struct(frame, value)).alias("b"))
    return ends.select(*on, at, F.try_divide(F.col(f"b.{value}") - F.col(f"a.{value}"), F.col(f"b.{frame}") - F.col(f"a.{frame}")).alias("speed"))


def crossings(df: DataFrame, by: list[str], order: str, value: str, level: Column, extra: str | None = None) -> DataFrame:
    """Rows where the value first reaches the level from below it (v0 < level <= v1), with what extra is at the level."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.where(F.col(value).isNotNull()).withColumn("_v", F.lag(value).over(w)).withColumn("_level", level)
    share = F.try_divide(F.col("_level") - F.col("_v"), F.col(value) - F.col("_v"))
    if extra:
        rows = rows.withColumn("_e", F.lag(extra).over(w))
    found = rows.where((F.col("_v") < F.col("_level")) & (F.col("_level") <= F.col(value)))
    return found.select(*by, order, share.alias("share"), *([(F.col("_e") + share * (F.col(extra) - F.col("_e"))).alias("at_level")] if extra else []))


def first_crossing(df: DataFrame, by: list[str], order: str, value: str, level: Column, extra: str | None = None) -> DataFrame:
    found = crossings(df, by, order, value, level, extra)
    rest = [c for c in found.columns if c not in by]
    return found.groupBy(*by).agg(F.min(F.struct(order, *(c for c in rest if c != order))).alias("_f")).select(*by, *(F.col(f"_f.{c}").alias(c) for c in rest))


def fold(df: DataFrame, by: list[str], order: list[str], fields: list[str], keep: Callable[[Column, Column], Column], name: str = "kept") -> DataFrame:
    """For each key the rows that `keep(kept so far, row)` lets in, in order, as an array of structs.

    For rules that depend on what was kept before. A key's rows are one array: use it where a key is small (a frame's
    candidates, a video's shots), never for keys that grow with the data.
    """
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order)))).alias("_r"))
    empty = F.slice("_r", 1, 0)
    return rows.select(*by, F.aggregate("_r", empty, lambda s, r: F.when(keep(s, r), F.concat(s, F.array(r))).otherwise(s)).alias(name))


def suppress_overlaps(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Intervals in order of start, without those that begin at or before the end of the last one kept; for keys of any size."""
    return choices.chained(df, by, start, end, touching=False)


def thin_out(df: DataFrame, by: list[str], at: str, apart: int) -> DataFrame:
    """Rows in order, without those nearer than `apart` to one kept before; for keys of any size."""
    return choices.chained(df.select(*by, at, (F.col(at) + apart).alias("_until")), by, at, "_until", touching=True).select(*by, at)


def peaks(df: DataFrame, by: list[str], at: str, score: str, least: float, apart: float) -> DataFrame:
    """The highest scores first, down to `least`, each more than `apart` from all kept ones; equal scores by `at`. Of rows at
    the same place one can be kept. Rows without a place are left out; for keys of any size."""
    return choices.peaks(df, by, at, score, least, apart)


def moving_sum(df: DataFrame, by: list[str], order: str, value: str, reach: int, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)))


def merge_candidates(df: DataFrame, by: list[str], seq: str, x: str, y: str, d: str, conf: str, share: float = 0.7, slot: str | None = None) -> DataFrame:
    """Candidates of a frame in input order; one that is near a kept one merges into it, and takes its place if surer.

    Near: centres closer than share times the larger diameter; the first such kept candidate counts. `slot` names a column for
    the place itself: the seq of the candidate that took it first.
    """
    row = F.struct(seq, x, y, d, conf, F.col(seq).alias("_slot"))
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_r"))

    def merge(s, r):
        close = lambda k: F.hypot(k[x] - r[x], k[y] - r[y]) < share * F.greatest(k[d], r[d])
        hits = F.filter(F.transform(s, lambda k, i: F.when(close(k), i)), lambda i: i.isNotNull())
        replaced = F.transform(s, lambda k, i: F.when((i == F.element_at(hits, 1)) & (r[conf] > k[conf]), r.withField("_slot", k["_slot"])).otherwise(k))
        return F.when(F.size(hits) == 0, F.concat(s, F.array(r))).otherwise(replaced)

    merged = rows.select(*by, F.inline(F.aggregate("_r", F.slice("_r", 1, 0), merge)))
    return merged.withColumnRenamed("_slot", slot) if slot else merged.drop("_slot")


def best_boxes(df: DataFrame, by: list[str], seq: str, conf: str, box: str, most: int = 3, overlap: float = 0.3) -> DataFrame:
    """The surest boxes of a frame that overlap no surer kept one by more than `overlap` (IoU), `most` of them."""
    from trackmill.functions.geometry import iou

    ranked = df.withColumn("_down", -F.col(conf))
    kept = fold(ranked, by, ["_down", seq], ["_down", seq, conf, box], lambda s, r: (F.size(s) < most) & ~F.exists(s, lambda k: iou(k[box], r[box]) > overlap))
    return kept.select(*by, F.inline("kept")).drop("_down")


def fill_gaps(df: DataFrame, by: list[str], frame: str, values: list[str], most: int = 12, degree: int = 2) -> DataFrame:
    """Rows for the frames of gaps of 2 to `most` frames, from a polynomial through the four rows before and after.

    The polynomial has the degree given, or 1 for fewer than four rows. Frames are centred on the gap, and the normal
    equations of up to three unknowns are solved in closed form.
    """
    w = Window.partitionBy(*by).orderBy(frame)
    rows = df.withColumn("_next", F.lead(frame).over(w)).withColumn("_near", F.collect_list(F.struct(frame, *values)).over(w.rowsBetween(-3, 4)))
    gaps = rows.where((F.col("_next") - F.col(frame)).between(2, most))
    gaps = gaps.withColumn("_t0", (F.col(frame) + F.col("_next")) / 2.0)
    t0 = F.col("_t0")  # a column of its own: within lambdas the frame's name would be the new frame
    total = lambda f: F.aggregate("_near", F.lit(0.0), lambda s, r: s + f(r))
    t = lambda r: r[frame] - t0
    s = [total(lambda r, k=k: F.pow(t(r), F.lit(float(k)))) for k in range(5)]
    quadratic = (F.size("_near") >= 4) & F.lit(degree >= 2)
    filled = gaps.withColumn("_f", F.explode(F.sequence(F.col(frame) + 1, F.col("_next") - 1)))
    out = []
    for v in values:
        m = [total(lambda r, k=k: r[v] * F.pow(t(r), F.lit(float(k)))) for k in range(3)]
        det2 = s[0] * s[2] - s[1] * s[1]
        line = (F.try_divide(m[0] * s[2] - m[1] * s[1], det2), F.try_divide(m[1] * s[0] - m[0] * s[1], det2), F.lit(0.0))
        det3 = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] * s[2])
        c0 = m[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (m[1] * s[4] - s[3] * m[2]) + s[2] * (m[1] * s[3] - s[2] * m[2])
        c1 = s[0] * (m[1] * s[4] - s[3] * m[2]) - m[0] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * m[2] - m[1] * s[2])
        c2 = s[0] * (s[2] * m[2] - m[1] * s[3]) - s[1] * (s[1] * m[2] - m[1] * s[2]) + m[0] * (s[1] * s[3] - s[2] * s[2])
        curve = tuple(F.try_divide(c, det3) for c in (c0, c1, c2))
        a, b, c = (F.when(quadratic, q).otherwise(k) for q, k in zip(curve, line))
        u = F.col("_f") - t0
        out.append((a + b * u + c * u * u).alias(v))
    return filled.select(*by, F.col("_f").cast(df.schema[frame].dataType).alias(frame), *out)


def best_per_frame(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order of columns."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest_share(df: DataFrame, by: list[str], at: str, share: float, name: str = "split") -> DataFrame:
    """Rows marked 'val' in the last share of a key's range, 'train' before; ranges come from grouped extremes."""
    ends = df.groupBy(*by).agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    return df.join(ends, by).withColumn(name, F.when(F.col(at) > F.col("_z") - share * (F.col("_z") - F.col("_a")), "val").otherwise("train")).drop("_a", "_z")


def every_nth(df: DataFrame, by: list[str], frame: str, step: int) -> DataFrame:
    """Every step-th frame, counted from a key's first."""
    firsts = df.groupBy(*by).agg(F.min(frame).alias("_a"))
    return df.join(firsts, by).where(F.pmod(F.col(frame) - F.col("_a"), F.lit(step)) == 0).drop("_a")


def evenly_spaced(df: DataFrame, first: str, last: str, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (F.col(first) + k * (F.col(last) - F.col(first)) / max(n - 1, 1)).cast("int"))))


def clean_views(df: DataFrame, by: list[str], frame: str, release: str, overlap: str, before: int = 12, after: int = 15, most: float = 0.3) -> DataFrame:
    """Rows near the release; only those that hardly overlap others, if a key has any such."""
    near = df.where((F.col(frame) - F.col(release)).between(-before, after)).withColumn("_clean", F.col(overlap) <= most)
    some = near.groupBy(*by).agg(F.bool_or("_clean").alias("_some"))
    return near.join(some, by).where(F.col("_clean") | ~F.col("_some")).drop("_clean", "_some")


def renumbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int"))


def only_once(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs once; all rows of other keys go."""
    return df.join(df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n"), key)


def upsert(table: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """The table with each change's value put for its key; a null value deletes the key."""
    new = changes.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_set"))
    return table.join(new, key, "full").select(key, F.when(F.col("_set"), F.col("_new")).otherwise(F.col(value)).alias(value)).where(F.col(value).isNotNull())
