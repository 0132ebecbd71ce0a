"""Tables for training sets and sheets, and the choice model, on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions import geometry
from trackmill.operators import datasets, models

BOX = "video string, frame int, track int, box struct<x:double,y:double,w:double,h:double>"


def people(spark):
    rows = [("v", 8, 1, (0.0, 0.0, 80.0, 200.0)), ("v", 8, 2, (40.0, 0.0, 81.0, 200.0)), ("v", 8, 3, (500.0, 0.0, 60.0, 100.0)), ("v", 8, 4, (700.0, 0.0, 60.0, 200.0)), ("v", 8, 4, (900.0, 0.0, 60.0, 200.0)), ("v", 9, 1, (0.0, 0.0, 80.0, 200.0)), ("v", 16, 5, (0.0, 0.0, 80.0, 200.0))]
    return spark.createDataFrame(rows, BOX), spark.createDataFrame([("v", 1, "A", 7), ("v", 2, None, 8), ("v", 3, "B", 9), ("v", 4, "B", 10), ("v", 5, "B", None)], "video string, track int, team string, number int")


def test_crop_index(spark):
    boxes, players = people(spark)
    rows = datasets.crop_index(boxes, players, every=8).orderBy("track").collect()
    assert [(r.file, r.team, r.number, r.occl, r.box_w, r.box_h) for r in rows] == [("v_f000008_t1.jpg", "A", 7, 0.5, 80, 200), ("v_f000008_t2.jpg", "", 8, 0.5, 81, 200)]
    assert datasets.crop_index(boxes.where("false"), players).count() == 0


def test_sheet_tiles_and_lines(spark):
    boxes, players = people(spark)
    spans = spark.createDataFrame([("v", 0, 16)], "video string, first int, last int")
    tiles = datasets.sheet_tiles(spans, boxes, players, frames=3, margin=0)
    got = [(r.frame, r.place, r.track, r.caption) for r in tiles.orderBy("frame", "place").collect()]
    assert got[:2] == [(8, 0, 2, "? #8 (81x120)"), (8, 1, 1, "A #7 (80x120)")] and got[-1] == (16, 0, 5, "B #? (80x120)") and len(got) == 6
    sizes = datasets.tile_sizes(tiles).first()
    assert (sizes.frames, sizes.crops, sizes.least_h, sizes.most_w) == (2, 6, 60, 81)
    line = spark.range(1).select(datasets.label_line(geometry.box(F.lit(90.0), F.lit(100.0), F.lit(20.0), F.lit(10.0)), F.lit(100), F.lit(0), 100, 200)).first()[0]
    assert line == "0 0.050000 0.525000 0.100000 0.050000"
    over = datasets.court_overlay(spark, "fiba_3x3", [100, 0, 50, 0, 100, 0, 0, 0, 1]).where("line = 'baseline'").orderBy("seq").collect()
    assert over[0].x + over[1].x == pytest.approx(100.0) and over[0].y == 0.0


def test_choice_model(spark):
    r = np.random.default_rng(1)
    x, group = r.normal(size=(400, 3)), np.repeat(np.arange(100), 4)
    best = (x[:, 0] * 2 - x[:, 1]).reshape(100, 4).argmax(1)
    chosen = np.zeros(400)
    chosen[np.arange(100) * 4 + best] = 1
    mixed = r.permutation(400)
    model = models.fit_choice(x[mixed], chosen[mixed], group[mixed], rounds=500)
    assert np.allclose(model["w"], models.fit_choice(x, chosen, group, rounds=500)["w"]) and model["w"][0] > 0 > model["w"][1]
    df = spark.createDataFrame([(int(g), i, *map(float, v)) for i, (g, v) in enumerate(zip(group, x))] + [(200, 0, None, None, None)], "g int, i int, a double, b double, c double")
    found = models.ranked_by_choice(df, ["g"], "i", [F.col(c) for c in "abc"], model)
    first = {q.g: q.i for q in found.where("rank = 1").collect()}
    assert np.mean([first[g] == 4 * g + best[g] for g in range(100)]) > 0.9 and first[200] == 0
    assert all(abs(q.s - 1) < 1e-9 for q in found.groupBy("g").agg(F.sum("p").alias("s")).collect())
    none = models.fit_choice(x, np.zeros(400), group)
    assert none["w"] == [0.0] * 3 and models.fit_choice(np.zeros((0, 2)), np.zeros(0), np.zeros(0, int))["w"] == [0.0, 0.0]


def test_equal_utilities_go_by_the_id(spark):
    """-7 (dist - 0.8) + 0.7 (n - 4) is the same for (d, 4), (d + 0.1, 5) and (d + 0.2, 6), but not in doubles."""
    rows = [(g, i, d, n) for g, d in enumerate(0.1 + k / 101 for k in range(40)) for i, d, n in ((1, d + 0.1, 5), (2, d, 4), (3, d + 0.2, 6))]
    found = models.ranked_by_choice(spark.createDataFrame(rows, "g int, i int, dist double, n int"), ["g"], "i", [F.col("dist"), F.col("n")], {"mean": [0.8, 4.0], "std": [0.3, 1.0], "w": [-2.1, 0.7]})
    assert all(r["rank"] == r.i for r in found.collect())
