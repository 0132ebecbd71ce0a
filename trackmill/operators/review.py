"""What a person who checks shots and frames sees: proposals to start from, what is done, where to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELEASE_AFTER_S = 0.40  # fixed value: the ball leaves the hands this long after the rise is seen to start


def is_complete(team: Column, made: Column, note: Column) -> Column:
    """Whether a label (strings) needs no more work: a team, made or missed, and no note that a program left ("auto..")."""
    known = team.isin("A", "B") & made.isin("0", "1")
    return F.coalesce(known, F.lit(False)) & ~F.startswith(F.coalesce(note, F.lit("")), F.lit("auto"))


def proposals(shots: DataFrame, fps: float = 30000 / 1001, blank: bool = False) -> DataFrame:
    """Found shots (video, release, made) as labels to check: strings, zone inside_arc, note 'auto', made left open if blank."""
    at = F.col("release") / F.lit(float(fps)) + F.lit(RELEASE_AFTER_S)
    made = F.lit("") if blank else F.when(F.col("made"), "1").otherwise("0")
    return shots.select("video", F.format_string("%.3f", at).alias("timestamp_s"), F.bround(at * F.lit(float(fps))).cast("int").cast("string").alias("frame"), F.lit("").alias("team"), F.lit("inside_arc").alias("zone"), made.alias("made"), F.lit("auto").alias("note"))


def progress(items: DataFrame, by: list[str], status: str, statuses: list[str], choice: Column | None = None, proposal: Column | None = None) -> DataFrame:
    """(by, items, decided, a count for each status, to_go, and changed if there are proposals) of items to review.

    An item is decided if it has a status; it was changed if its status is 'ok' and its choice isn't the proposal, whichever of
    them is missing.
    """
    s = F.col(status)
    counts = [F.count("*").alias("items"), F.count(s).alias("decided"), *(F.count_if(s == n).alias(n) for n in statuses), F.count_if(s.isNull()).alias("to_go")]
    if choice is not None and proposal is not None:
        counts.append(F.count_if((s == "ok") & ~choice.eqNullSafe(proposal)).alias("changed"))
    return items.groupBy(*by).agg(*counts)


def first_undecided(items: DataFrame, by: list[str], seq: str, status: str, default_first: bool = True) -> DataFrame:
    """(by, seq): where to go on: the first item without a status; if there is none the first item, or null."""
    open_ = F.min(F.when(F.col(status).isNull(), F.col(seq)))
    return items.groupBy(*by).agg((F.coalesce(open_, F.min(seq)) if default_first else open_).alias(seq))
