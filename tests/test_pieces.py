"""Rows of several tables side by side, over the ends of stretches, and plans that shuffle only the tables' own rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from trackmill.functions import court
from trackmill.operators import composites, pieces, shots


def test_rows_meet_over_the_ends_of_stretches(spark):
    asking = spark.createDataFrame([("v", 9, 1), ("v", 10, 2), ("w", 0, 3), (None, 5, 4), ("v", None, 5)], "video string, frame int, id int")
    rows = spark.createDataFrame([("v", f) for f in range(0, 31)] + [("w", 2), (None, 5), ("v", None)], "video string, frame int")

    def work(own, others):
        there = others["rows"]
        code, frame = pieces.whole(there, "code"), pieces.whole(there, "frame")
        found = [int(((code == c) & (frame >= f - 3) & (frame <= f + 2)).sum()) for c, f in zip(pieces.whole(own, "code").tolist(), pieces.whole(own, "frame").tolist())]
        yield from pa.table({"id": own.column("id"), "n": pa.array(found)}).to_batches()

    for piece in (1, 4, 10, 100):
        assert {r.id: r.n for r in pieces.in_pieces(asking, {"rows": rows}, 3, 2, work, "id int, n long", piece).collect()} == {1: 6, 2: 6, 3: 1, 4: 0, 5: 0}


def test_shots_and_players_are_shuffled_once(spark):
    persons = spark.range(100).select(F.lit("v").alias("video"), (F.col("id") * 3).cast("int").alias("frame"), F.lit(1).alias("track"), F.struct(*(F.lit(float(k)).alias(c) for k, c in enumerate("xywh", 1))).alias("box"))
    shots = spark.range(5).select(F.lit("v").alias("video"), F.col("id").alias("shot"), (F.col("id") * 40).cast("int").alias("release"))
    ball = spark.range(300).select(F.lit("v").alias("video"), F.col("id").cast("int").alias("frame"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    for found in (composites.choice_features(shots, persons, ball), composites.shooter_info(shots, persons, ball, [[1, 0, 0], [0, 1, 0], [0, 0, 1]], court.court("fiba_3x3"))):
        assert found.count() == 5 and found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_a_dealt_track_is_not_shuffled_again(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    videos = spark.range(20).select(F.col("id").alias("video")).repartition(n, "video")
    k = F.col("frame")
    y = F.when(k <= 25, 400 + 1000 * (25 - k) * (25 - k) / 625.0).otherwise(400 + 1100 * (k - 25) * (k - 25) / 900.0)
    track = videos.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(60)))).select("video", "frame", F.lit(1800.0).alias("x"), y.alias("y"))
    rims = spark.range(20).select(F.col("id").alias("video"), F.lit(1800.0).alias("rx"), F.lit(840.0).alias("ry"), F.lit(33.0).alias("rr"))
    found = shots.detect_shots(track, rims)
    assert [(r.release, r.apex, r.cross, r.dx, r.made) for r in found.collect()] == [(0, 25, 44, 0.0, True)] * 20
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 2 and plan.index("Generate") < plan.index("Exchange ")  # videos and rims; the track comes after
