"""Writers of events, statistics, labels and keyed decisions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.court import POINT_NAMES, ZONES
from trackmill.operators.aggregates import in_player_order
from trackmill.operators.sequences import renumbered
from trackmill.sources.readers import CALIBRATION, EVENT_COLUMNS


def write_events(df: DataFrame, path: str) -> None:
    """CSV in the fixed order of columns, flags as 0 and 1, nulls blank; by video if df has that column."""
    by = _video(df)
    rows = df.select(*by, *(F.col(c).cast("int").alias(c) if c == "made" else F.col(c) for c in EVENT_COLUMNS))
    rows.write.mode("overwrite").option("header", True).partitionBy(*by).csv(path)


def _video(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "video"]


def statistics(stats: DataFrame, rules: str, players: DataFrame | None = None) -> DataFrame:
    """(value, and video if stats has it): the statistics as JSON, from zone_statistics over ZONES.

    {"rules", "teams": {team: {zone label: {attempts, made, pct}, .., "overall", "points"}}, "total": the same, "players"}.
    Zones have the labels of the rules; a share over no attempts is null. Players (player_table) are there only if some number
    of the video is known or tried ("?"), in the order of in_player_order.
    """
    by = _video(stats)
    cell = lambda z: F.max(F.when(F.col("zone") == z, F.struct("attempts", "made", "pct")))
    names = POINT_NAMES[rules]
    block = F.struct(*(F.col(names[z]) for z in ZONES), "overall", "points")
    teams = stats.groupBy(*by, "team").agg(*(cell(z).alias(names[z]) for z in ZONES), cell("*").alias("overall"), F.max(F.when(F.col("zone") == "*", F.col("points"))).alias("points"))
    rows = teams.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("team") != "*", F.struct("team", block.alias("b")))))).alias("teams"), F.max(F.when(F.col("team") == "*", block)).alias("total"))
    fields = [F.lit(rules).alias("rules"), F.col("teams"), F.col("total")]
    text = lambda *more: F.to_json(F.struct(*fields, *more), {"ignoreNullFields": "false"})
    if players is None:
        return rows.select(*by, text().alias("value"))
    line = F.struct((F.col("team") == "?").alias("a"), F.col("team").alias("b"), (F.col("player") == "?").alias("c"), F.col("player").try_cast("int").alias("d"), F.col("player").alias("e"), F.struct(*_player_columns()).alias("row"))
    lists = players.groupBy(*by).agg(F.array_sort(F.collect_list(line)).getField("row").alias("players"))
    both = rows.join(lists, by, "left") if by else rows.crossJoin(lists)  # without a video each side is one row
    return both.select(*by, F.when(F.size("players") > 0, text(F.col("players"))).otherwise(text()).alias("value"))


def _player_columns() -> list[Column]:
    """A player's columns by the names that the files have."""
    return [F.col(c).alias(n) for c, n in (("team", "team"), ("player", "number"), ("attempts", "attempts"), ("made", "makes"), ("fg_pct", "fg_pct"), ("points", "points"))]


def write_statistics(stats: DataFrame, rules: str, path: str, players: DataFrame | None = None) -> None:
    """`statistics` as text, a line for each video (in a folder of its own) or one line."""
    rows = statistics(stats, rules, players)
    rows.write.mode("overwrite").partitionBy(*_video(rows)).text(path)


def write_players(table: DataFrame, path: str) -> None:
    in_player_order(table).select(*_video(table), *_player_columns()).write.mode("overwrite").option("header", True).csv(path)


def keyed_json(df: DataFrame, by: list[str], key: str, numeric: bool = False) -> DataFrame:
    """(by, value): each video's rows as one JSON object from the key to the other columns, ordered by the key.

    Keys sort as strings, or as integers if they are numeric (event ids); a key that occurs twice raises. An object holds one
    video's decisions, which a person made one by one.
    """
    rest = [c for c in df.columns if c not in (*by, key)]
    order = F.col(key).cast("int") if numeric else F.col(key).cast("string")
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(key).cast("string").alias("k"), F.struct(*rest).alias("v")))).alias("r"))
    return rows.select(*by, F.to_json(F.map_from_entries(F.transform("r", lambda r: F.struct(r["k"], r["v"])))).alias("value"))


def write_keyed_json(df: DataFrame, by: list[str], key: str, path: str, numeric: bool = False) -> None:
    keyed_json(df, by, key, numeric).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(path)


def write_calibrations(df: DataFrame, path: str, lines: bool = False) -> None:
    """A JSON object for each row of CALIBRATION's fields, by video; or, for very many videos, with the video as a line of files
    that hold many (`lines`), as a file for each would take far longer to make and to find than its line."""
    names = [part.split(" ")[0] for part in CALIBRATION.split(", ")]
    if lines:
        df.select(F.to_json(F.struct(F.col("video").cast("string").alias("video"), *names), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
        return
    fields = F.struct(*names)
    df.select("video", F.to_json(fields, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy("video").text(path)


def model_text(model: dict, features: list[str]) -> str:
    """A make model's parameters as JSON, with the features that it was fitted on; read_model takes it back."""
    numbers = lambda v: [float(x) for x in v]
    return json.dumps({"features": features, "mean": numbers(model["mean"]), "std": numbers(model["std"]), "w": numbers(model["w"]), "b": float(model["b"]), "threshold": float(model["threshold"])}, indent=1)


def write_labels(df: DataFrame, by: list[str], path: str, order: list[str | Column] | None = None) -> None:
    """Labels in order of time, numbered from 0 within a video; equal times go by the event_id that they had, if any. `order`
    is another order, of columns of df."""
    had = [c for c in ("event_id",) if c in df.columns]
    numbered = renumbered(df, by, order or ["timestamp_s", *had], "_number").drop("event_id").withColumnRenamed("_number", "event_id")
    numbered.write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)


def write_by_video(df: DataFrame, path: str) -> None:
    """Parquet by video; only the videos in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").parquet(path)
