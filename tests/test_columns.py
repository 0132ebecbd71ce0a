"""Columns over pictures and cameras on nulls and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from trackmill.functions import court, geometry, pixels


def test_homographies_by_row(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]]
    there = [[1.0, 1.0], [9.0, 1.0], [9.0, 5.0], [1.0, 5.0]]
    rows = [(1, square, there), (2, square, there[:3]), (3, None, there), (4, square[:3], there[:3]), (5, square + [[2.0, 1.0]], there + [[5.0, 4.0]])]
    found = {r.k: r.m for r in spark.createDataFrame(rows, "k int, a array<array<double>>, b array<array<double>>").select("k", geometry.homography_column(F.col("a"), F.col("b")).alias("m")).collect()}
    assert np.allclose(found[1].h, [2, 0, 1, 0, 2, 1, 0, 0, 1]) and abs(found[1].error) < 1e-9
    assert all(found[k].h is None and found[k].error is None for k in (2, 3, 4)) and 0.1 < found[5].error < 1


def test_pictures_by_row(spark):
    rows = [(bytearray([0, 255, 0] * 4), 2, 2), (None, None, None), (bytearray([9, 9, 9] * 4), 2, 2)]
    df = spark.createDataFrame(rows, "image binary, h int, w int")
    hues = [r[0] for r in df.select(pixels.court_hue_column("image")).collect()]
    assert hues == [60.0, None, None]
    boxed = [r[0] for r in df.select(pixels.letterbox_column("image", "h", "w", 4)).collect()]
    assert bytes(boxed[0]) == bytes([0, 255, 0] * 16) and boxed[1] is None and len(boxed[2]) == 48


def test_edges_of_the_free_throw_spot(spark):
    rows = spark.createDataFrame([(1.47, 6.4), (-1.47, 5.6), (0.0, 6.4000001), (0.0, 5.5999999), (1.4700001, 6.0)], "x double, y double")
    spot = court.at_ft_spot(court.court("fiba_3x3"), F.col("x"), F.col("y"))
    assert [r.s for r in rows.select(spot.alias("s")).collect()] == [True, True, False, False, False]
