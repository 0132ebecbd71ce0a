"""Joins on nearness: band joins, nearest rows, one-to-one matching, and agreement after matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.court import points_for
from trackmill.functions.values import ratio
from trackmill.operators import choices


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, below, above, how: str = "inner", width=None) -> DataFrame:
    """Pairs with equal `on` and right_at - left_at in [-below, above], as an equi-join on buckets of the axis.

    right stands in its bucket; left looks into each bucket that its band touches (one row each), so every pair meets
    once and no nested loop is planned. Nulls meet nothing. Columns but `on` must differ between the sides.
    """
    width = width or max(below + above, 1e-9)
    first, last = (F.floor((F.col(left_at) + d) / F.lit(width)) for d in (-below, above))
    looking = left.withColumn("_bucket", F.explode_outer(F.sequence(first, last)))
    standing = right.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(c for c in right.columns if c not in on), F.floor(F.col(right_at) / F.lit(width)).alias("_at"))
    near = [F.col(c) == F.col(f"_on_{c}") for c in on] + [F.col("_bucket") == F.col("_at"), (F.col(right_at) - F.col(left_at)).between(-below, above)]
    pairs = looking.join(standing, near, "inner").drop("_bucket", "_at", *(f"_on_{c}" for c in on))
    if how == "inner":
        return pairs
    keys = [*left.columns]
    return left.join(pairs, [left[k].eqNullSafe(pairs[k]) for k in keys], "left").drop(*(pairs[k] for k in keys))


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_id: list[str], left_at: str, right_at: str, tolerance, tie: str, how: str = "left") -> DataFrame:
    """For each left row the right row nearest on the axis within the tolerance, ties by the smallest `tie`.

    The choice is a grouped minimum of a struct, so only one candidate a row and task is shuffled.
    """
    payload = [c for c in right.columns if c not in on]
    pairs = band_join(left.select(*on, *left_id, left_at), right, on, left_at, right_at, tolerance, tolerance)
    best = pairs.groupBy(*on, *left_id).agg(F.min(F.struct(F.abs(F.col(right_at) - F.col(left_at)).alias("_d"), F.col(tie).alias("_t"), F.struct(*payload).alias("_r"))).alias("_b"))
    return left.join(best, [*on, *left_id], how).select(*left.columns, *(F.col(f"_b._r.{c}").alias(c) for c in payload))


def floor_aligned(left: DataFrame, right: DataFrame, on: list[str], frame: str, step: int) -> DataFrame:
    """left with the right rows of the sampled frame at or before its own."""
    at = F.col(frame) - F.pmod(F.col(frame), F.lit(step))
    return left.withColumn("_at", at).join(right.withColumnRenamed(frame, "_at"), [*on, "_at"], "left").drop("_at")


def carried_forward(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """value, or where it is null the last one before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def one_to_one(gt: DataFrame, pred: DataFrame, on: list[str], gt_id: str, pred_id: str, gt_at: str, pred_at: str, tolerance) -> DataFrame:
    """(on, gt_id, pred_id, delta): pairs within the tolerance, taken nearest first, each row used once.

    Pairs are in strict order of (delta, gt_id, pred_id), and taken in blocks of neighbouring rows (see choices).
    """
    pairs = band_join(gt.select(*on, gt_id, gt_at), pred.select(*on, pred_id, pred_at), on, gt_at, pred_at, tolerance, tolerance)
    named = pairs.select(*on, gt_id, pred_id, F.abs(F.col(pred_at) - F.col(gt_at)).alias("delta"), F.col(gt_at).alias("_at"))
    return choices.pairs_one_to_one(named, on, gt_id, pred_id, "delta", "_at").select(*on, gt_id, pred_id, "delta")


def swap_of(gt_team: Column, pred_team: Column, names: tuple[str, str] = ("A", "B")) -> Column:
    """As an aggregate: whether the names agree strictly better when they are exchanged."""
    a, b = names
    other = F.when(pred_team == a, b).when(pred_team == b, a)
    return F.count_if(gt_team == other) > F.count_if(gt_team == pred_team)


def evaluate(gt: DataFrame, pred: DataFrame, on: list[str], tolerance: float = 1.0, rules: str | None = None) -> DataFrame:
    """For each key: matched, recall, precision, and the accuracy of make, zone and team over matched pairs; team names
    are exchanged if that agrees strictly better; the error in points of each team that the truth has and of all, never
    below zero, with the same exchange. Pairs whose true team is unknown ('?' or null) don't count for the teams.

    gt and pred have event_id, timestamp_s, team, zone and made. With rules, points follow from these, the zone and made, as
    labels have none of their own; without, both sides have a column points.
    """
    if rules is not None:
        gt, pred = (df.withColumn("points", points_for(F.lit(rules), F.col("zone"), F.col("made"))) for df in (gt, pred))
    fields = ["event_id", "timestamp_s", "team", "zone", "made", "points"]
    g, p = (df.select(*on, *(F.col(c).alias(f"{s}_{c}") for c in fields)) for df, s in ((gt, "g"), (pred, "p")))
    pairs = one_to_one(g, p, on, "g_event_id", "p_event_id", "g_timestamp_s", "p_timestamp_s", tolerance)
    both = pairs.join(g, [*on, "g_event_id"]).join(p, [*on, "p_event_id"])
    same, other = F.col("g_team") == F.col("p_team"), ((F.col("g_team") == "A") & (F.col("p_team") == "B")) | ((F.col("g_team") == "B") & (F.col("p_team") == "A"))
    known = F.col("g_team") != "?"
    scored = both.groupBy(*on).agg(F.count("*").alias("matched"), F.count_if(F.col("g_made") == F.col("p_made")).alias("made_ok"), F.count_if(F.col("g_zone") == F.col("p_zone")).alias("zone_ok"), F.greatest(F.count_if(known & same), F.count_if(known & other)).alias("team_ok"), F.count_if(known).alias("team_n"), swap_of(F.when(known, F.col("g_team")), F.col("p_team")).alias("swapped"))

    def totals(df, s):
        team = F.col(f"{s}_team")
        return df.groupBy(*on).agg(F.count("*").alias(f"{s}_n"), *(F.sum(F.when(team == t, F.col(f"{s}_points"))).alias(f"{s}_{t}") for t in ("A", "B")), F.coalesce(F.sum(f"{s}_points"), F.lit(0)).alias(f"{s}_all"))

    swapped = F.coalesce("swapped", F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        totals(g, "g").join(totals(p, "p"), on, "full").join(scored, on, "left")
        .select(
            *on, zero("matched").alias("matched"), ratio(zero("matched"), zero("g_n")).alias("recall"), ratio(zero("matched"), zero("p_n")).alias("precision"),
            *(ratio(zero(f"{k}_ok"), zero("matched")).alias(f"{k}_accuracy") for k in ("made", "zone")), ratio(zero("team_ok"), zero("team_n")).alias("team_accuracy"), swapped.alias("swapped"),
            F.abs(F.when(swapped, zero("p_B")).otherwise(zero("p_A")) - F.col("g_A")).alias("points_error_a"), F.abs(F.when(swapped, zero("p_A")).otherwise(zero("p_B")) - F.col("g_B")).alias("points_error_b"), F.abs(zero("p_all") - zero("g_all")).alias("points_error"),
        )
    )


def with_labels(items: DataFrame, labels: DataFrame, on: list[str], value: str, default: Column | None = None) -> DataFrame:
    """Items with the value of their label, or a default; of several labels of a key the largest value counts, and a key's
    labels are brought down to one before the join, so items never multiply."""
    one = labels.groupBy(*on).agg(F.max(value).alias(value))
    out = items.join(one, on, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, default))


def unmatched(rows: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no pair uses: misses of one side, extras of the other."""
    return rows.join(pairs.select(*keys).distinct(), keys, "left_anti")


def in_window(events: DataFrame, rows: DataFrame, on: list[str], at: str, frame: str, before: int, after: int) -> DataFrame:
    """Each event with the rows whose integer frame is in [at - before, at + after]."""
    return band_join(events, rows, on, at, frame, before, after)


def agreement(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """For each key the share of agreement under the better of the two ways to name two classes."""
    same, swap = F.count_if(F.col(truth) == F.col(guess)), F.count_if(F.col(truth) == F.when(F.col(guess) == "A", "B").when(F.col(guess) == "B", "A"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), same.alias("same"), swap.alias("swap")).select(*by, "n", (F.col("same") >= F.col("swap")).alias("identity"), ratio(F.greatest("same", "swap"), F.col("n")).alias("accuracy"))
