"""Grouped statistics, votes and rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.values import ratio, renormalised


def zone_statistics(df: DataFrame, team: str, zone: str, made: Column, points: Column | None = None, zones: list[str] | None = None, digits: int = 3, by: list[str] | None = None) -> DataFrame:
    """(by, team, zone, attempts, made, pct, points) by grouping sets: team and zone, team, zone, all; '*' is a total.

    Every zone is there for every team, with no attempts if need be. One aggregation feeds all four levels.
    """
    by = by or []
    rows = df.select(*by, F.col(team).alias("team"), F.col(zone).alias("zone"), made.cast("int").alias("m"), (points if points is not None else F.lit(0)).alias("p"))
    base = rows.groupBy(*by, "team", "zone").agg(F.count("*").alias("a"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"))
    if zones:
        domain = base.select(*by, "team").distinct().withColumn("zone", F.explode(F.array(*map(F.lit, zones))))
        base = base.unionByName(domain.select(*by, "team", "zone", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("m"), F.lit(0).cast(base.schema["p"].dataType).alias("p")))
    own, t, z = [F.col(c) for c in by], F.col("team"), F.col("zone")
    cube = base.groupingSets([[*own, t, z], [*own, t], [*own, z], own], *by, "team", "zone").agg(F.grouping("team").alias("gt"), F.grouping("zone").alias("gz"), F.sum("a").alias("attempts"), F.sum("m").alias("made"), F.sum("p").alias("points"))
    return cube.select(*by, F.when(F.col("gt") == 1, "*").otherwise(F.col("team")).alias("team"), F.when(F.col("gz") == 1, "*").otherwise(F.col("zone")).alias("zone"), "attempts", "made", ratio(F.col("made"), F.col("attempts"), digits).alias("pct"), "points")


def player_table(df: DataFrame, team: str = "team", player: str = "player", made: str = "made", points: str = "points", by: list[str] | None = None) -> DataFrame:
    """Attempts, makes, share and points of each player; unknown teams and numbers ('?') come last in the order columns."""
    by = by or []
    known = df.select(*by, F.coalesce(team, F.lit("?")).alias("team"), F.coalesce(F.nullif(F.col(player), F.lit("")), F.lit("?")).alias("player"), F.col(made).cast("int").alias("m"), F.col(points).alias("p"))
    return known.groupBy(*by, "team", "player").agg(F.count("*").alias("attempts"), F.sum("m").alias("made"), ratio(F.sum("m"), F.count("*"), 3).alias("fg_pct"), F.sum("p").alias("points"))


def in_player_order(table: DataFrame) -> DataFrame:
    return table.orderBy(F.col("team") == "?", "team", F.col("player") == "?", F.col("player").try_cast("int"), "player")


def majority(df: DataFrame, by: list[str], label: str, share: float = 0.6, unknown: str = "?") -> DataFrame:
    """The label with at least this share of the known labels of a key, or unknown."""
    counts = df.where(F.col(label).isNotNull() & (F.col(label) != unknown)).groupBy(*by, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("n", label)).alias("b"), F.sum("n").alias("known"))
    every = df.select(*by).distinct()
    return every.join(best, by, "left").select(*by, F.coalesce("known", F.lit(0)).alias("known"), F.when(F.col("b.n") >= share * F.col("known"), F.col(f"b.{label}")).otherwise(unknown).alias("vote"))


def weighted_vote(df: DataFrame, by: list[str], probs: str, allowed: Column | None = None, least: float = 0.5) -> DataFrame:
    """(by, class, share, rows): the class with most probability over a key's rows whose best class has at least `least`.

    Probabilities are renormalised over the allowed classes row by row; of equal sums the first class wins; a key without
    such a row has a null class and share 0. The sums go by (key, class), so no row array is gathered.
    """
    rows = df.select(*by, renormalised(F.col(probs), allowed).alias("_p"))
    sums = rows.where(F.array_max("_p") >= least).select(*by, F.posexplode("_p").alias("_k", "_v")).groupBy(*by, "_k").agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"))
    best = sums.groupBy(*by).agg(F.max(F.struct("_s", (-F.col("_k")).alias("_k"))).alias("_b"), F.sum("_s").alias("_all"), F.max("_n").alias("_rows"))
    return df.select(*by).distinct().join(best, by, "left").select(*by, (-F.col("_b._k")).alias("class"), F.coalesce(F.try_divide("_b._s", "_all"), F.lit(0.0)).alias("share"), F.coalesce("_rows", F.lit(0)).alias("rows"))


def rosters(df: DataFrame, team: str, probs: str, k: int = 3, least: float = 0.5, unknown: str = "?") -> DataFrame:
    """(team, class, mass, rank): the k classes with most probability of each known team, over rows that are sure."""
    mass = df.where((F.col(team) != unknown) & (F.array_max(probs) >= least)).select(F.col(team).alias("team"), F.posexplode(probs).alias("class", "v")).groupBy("team", "class").agg(F.sum("v").alias("mass")).where("mass > 0")
    return mass.withColumn("rank", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("mass"), "class"))).where(F.col("rank") <= k)


def running_total(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count("*").alias("n"))


def count_errors(gt: DataFrame, pred: DataFrame, by: list[str], made: str) -> DataFrame:
    """Mean absolute errors of attempts and makes over the keys of the truth."""
    g, p = (df.groupBy(*by).agg(F.count("*").alias(f"{s}a"), F.sum(F.col(made).cast("int")).alias(f"{s}m")) for df, s in ((gt, "g"), (pred, "p")))
    both = g.join(p, by, "left")
    return both.agg(F.count("*").alias("keys"), F.avg(F.abs(F.col("ga") - F.coalesce("pa", F.lit(0)))).alias("attempt_error"), F.avg(F.abs(F.col("gm") - F.coalesce("pm", F.lit(0)))).alias("make_error"))


def tracking_quality(df: DataFrame, by: list[str], truth: str, found: str, error: str, size: str) -> DataFrame:
    """(by, frames, recall, median_error, none_frames, false_alarms) of positions in labelled frames.

    A ball is recalled if it is found within the larger of 20 px and three quarters of its size. The median is that of all
    found balls' errors, the far ones too, and null without any. Rates over no frames are 0.
    """
    seen = F.col(truth) & F.col(found)
    hit = seen & (F.col(error) <= F.greatest(F.lit(20.0), 0.75 * F.col(size)))
    rate = lambda a, b: F.count_if(a) / F.greatest(F.count_if(b), F.lit(1))
    return df.groupBy(*by).agg(F.count_if(F.col(truth)).alias("frames"), rate(hit, F.col(truth)).alias("recall"), F.median(F.when(seen, F.col(error))).alias("median_error"), F.count_if(~F.col(truth)).alias("none_frames"), rate(~F.col(truth) & F.col(found), ~F.col(truth)).alias("false_alarms"))


def coverage(shots: DataFrame, points: DataFrame, on: list[str], start: str, frames: int, frame: str, reach: Column, ends: DataFrame | None = None, end: str = "frames") -> DataFrame:
    """(on, start, covered, nearest): for each shot the share of its frames with a point, and the least reach of them.

    ends (on, end) has the number of frames of each video: a shot's frames stop there. A shot with no frame of its own has a
    null share. points has a row a frame at most.
    """
    last = F.col(start) + (frames - 1)
    shots = shots.select(*on, start) if ends is None else shots.select(*on, start).join(ends.select(*on, end), on)
    last = last if ends is None else F.least(last, F.col(end) - 1)
    asked = shots.withColumn("_last", last).select(*on, start, F.explode_outer(F.when(F.col("_last") >= F.col(start), F.sequence(F.col(start), F.col("_last")))).alias(frame))
    found = asked.join(points.select(*on, frame, reach.alias("_r")), [*on, frame], "left")
    return found.groupBy(*on, start).agg(F.avg(F.when(F.col(frame).isNotNull(), F.col("_r").isNotNull().cast("double"))).alias("covered"), F.min("_r").alias("nearest"))


def coverage_summary(df: DataFrame, by: list[str], reach: Column, most: float = 0.8) -> DataFrame:
    """(by, shots, median_covered, well_covered, reached): coverage's rows in sum; reached counts those within a reach."""
    return df.groupBy(*by).agg(F.count("*").alias("shots"), F.median("covered").alias("median_covered"), F.count_if(F.col("covered") >= most).alias("well_covered"), F.count_if(F.coalesce(F.col("nearest") <= reach, F.lit(False))).alias("reached"))


def tumbling_votes(df: DataFrame, by: list[str], frame: str, width: int, truth: str, probs: str, least: float = 0.5) -> DataFrame:
    """Votes over tumbling windows of frames, with the truth of the window; undecided windows count as wrong."""
    rows = df.withColumn("window", F.floor(F.col(frame) / F.lit(width)).cast("long"))
    voted = weighted_vote(rows, [*by, "window", truth], probs, None, least)
    return voted.select(*by, "window", truth, "class", "share", F.coalesce(F.col("class") == F.col(truth), F.lit(False)).alias("right"))


def accuracy_at(df: DataFrame, truth: str, guess: str, confidence: str, levels: tuple = (0.5, 0.8, 0.95)) -> DataFrame:
    """(level, coverage, accuracy) of predictions at each confidence, in one pass."""
    cells = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), (F.col(confidence) >= v).alias("sure"), (F.col(truth) == F.col(guess)).alias("right")) for v in levels)))
    return df.select(cells.alias("c")).groupBy("c.level").agg(F.avg(F.col("c.sure").cast("double")).alias("coverage"), ratio(F.count_if(F.col("c.sure") & F.col("c.right")), F.count_if(F.col("c.sure"))).alias("accuracy"))


def with_totals(df: DataFrame, by: str, sums: dict[str, Column], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Sums for each key and over all ('total'), and ratios of them."""
    rolled = df.rollup(by).agg(F.grouping(by).alias("_g"), *(c.alias(n) for n, c in sums.items()))
    return rolled.select(F.when(F.col("_g") == 1, "total").otherwise(F.col(by)).alias(by), *sums, *(ratio(F.col(a), F.col(b)).alias(n) for n, (a, b) in ratios.items()))


def first_known(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The first value of each key that isn't empty."""
    full = F.col(value).isNotNull() & (F.size(value) > 0)
    return df.groupBy(*by).agg(F.min(F.when(full, F.struct(order, value))).getField(value).alias(value))


def identities(shots: DataFrame, roster: DataFrame, shot: str, team: str, number: str, unknown: str = "?") -> DataFrame:
    """Shots with the team of the only roster that has the number; others keep theirs."""
    only = roster.groupBy(F.col("class").alias(number)).agg(F.min("team").alias("_team"), F.countDistinct("team").alias("_n")).where("_n = 1").drop("_n")
    return shots.join(only, number, "left").withColumn(team, F.coalesce("_team", team)).drop("_team")
