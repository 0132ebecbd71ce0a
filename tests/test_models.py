"""Models fitted in Spark against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.operators import models


def table(spark, seed=0, n=160, folds=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4)) * [1, 5, 0.1, 100] + [0, 3, 0, -1000]
    y = (x[:, 0] + r.normal(size=n) > 0).astype(int)
    fold = [f"v{i % folds}" if i % folds else None for i in range(n)]
    rows = [(f, v.tolist(), int(k)) for f, v, k in zip(fold, x, y)] + [("v1", None, 1), ("v1", [0.0, 0.0, 0.0, 0.0], None)]
    return x, y, np.array(fold, object), spark.createDataFrame(rows, "video string, x array<double>, y int").repartition(3)


def close(a, b, bound):
    return all(np.abs(np.array(a[k]) - np.array(b[k])).max() < bound for k in ("mean", "std", "w", "b"))


def test_gradient_steps_of_all_folds(spark):
    x, y, fold, df = table(spark)
    found = models.fit_by_fold(df, "video", "x", "y", rounds=25)
    assert set(found) == {None, "v1", "v2", "v3", "v4", ...}
    for f, m in found.items():
        use = np.array([g != f for g in fold])
        assert close(m, models.fit_logistic(x[use], y[use], rounds=25), 1e-9)


def test_newton_reaches_where_gradient_steps_go(spark):
    x, y, fold, df = table(spark, 1)
    found = models.fit_by_fold(df, "video", "x", "y", penalty=3.0)
    for f, m in found.items():
        use = np.array([g != f for g in fold])
        assert close(m, models.fit_logistic(x[use], y[use], rounds=60_000, penalty=3.0), 1e-7)


def test_nothing_is_joined_or_repeated(spark):
    _, _, _, df = table(spark)
    out = models.leave_one_out(df, "video", "x", "y")
    assert "Join" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    rows = {r.fold: r for r in out.collect()}
    assert rows["v1"].n == 33 and sum(r.n for r in rows.values()) == 161 and sum(r.right for r in rows.values()) > 100


def test_leave_one_out_is_what_a_loop_gives(spark):
    x, y, fold, df = table(spark, 2)
    found = {r.fold: (r.n, r.right) for r in models.leave_one_out(df, "video", "x", "y", rounds=30).collect()}
    for f in set(fold):
        use = np.array([g != f for g in fold])
        right = int(((models.scores(models.fit_logistic(x[use], y[use], rounds=30), x[~use]) > 0.5) == y[~use]).sum())
        assert found[f] == (int((~use).sum()) + (f == "v1"), right)  # the row without features has label 1


def test_one_fold_and_none(spark):
    df = spark.createDataFrame([("a", [1.0], 1), ("a", [0.0], 0)], "video string, x array<double>, y int")
    assert models.fit_by_fold(df, "video", "x", "y")["a"]["w"] == [0.0]
    assert models.leave_one_out(df, "video", "x", "y").first().n == 2
    assert models.fit_by_fold(df.limit(0), "video", "x", "y") == {} and models.leave_one_out(df.limit(0), "video", "x", "y").count() == 0


def lloyd(x, a, b):
    c = np.array([a, b])
    for _ in range(101):
        side = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[side == k].mean(0) if (side == k).any() else c[k] for k in (0, 1)])
        cost = ((x - c[side]) ** 2).sum()
        if np.sqrt(((new - c) ** 2).sum(1)).max() <= 1e-4:
            return new, cost
        c = new
    return c, cost


@pytest.mark.parametrize("seed", range(3))
def test_best_of_ten_starts(spark, seed):
    """Three clumps: single starts stop at different costs."""
    r = np.random.default_rng(seed)
    x = np.abs(np.concatenate([np.eye(72)[k] + r.normal(0, 0.05, (n, 72)) for k, n in ((8, 40), (12, 25), (40, 30))]))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(4)
    centres, cost = models.colour_clusters(rows, seed=seed)
    runs = [lloyd(x, x[i], x[j]) for i, j in (r.choice(len(x), 2, replace=False) for _ in range(60))]
    best = min(c for _, c in runs)
    assert cost <= best + 1e-6 and len({round(c, 3) for _, c in runs}) > 1
    c = min(runs, key=lambda v: v[1])[0]
    own, theirs = (((x[:, None] - m) ** 2).sum(2).argmin(1) for m in (np.array(centres), c))
    assert (own == theirs).all() or (own == 1 - theirs).all()
    again, _ = models.colour_clusters(rows.repartition(2), seed=seed)
    assert np.allclose(sorted(again.tolist()), sorted(centres.tolist()))


def test_team_of(spark):
    r = np.random.default_rng(1)
    rows = [(np.abs(np.eye(72)[8 if i % 2 else 40] + r.normal(0, 0.02, 72)).tolist(), 0.5) for i in range(60)] + [(None, 0.5)]
    df = spark.createDataFrame(rows, "v array<double>, s double")
    model = models.team_colours(df, "v")
    asked = spark.createDataFrame([(np.eye(72)[8].tolist(), 0.5), (np.eye(72)[40].tolist(), 0.2), (np.eye(72)[8].tolist(), 0.1), (np.eye(72)[60].tolist(), 0.9), (None, 0.9), (np.eye(72)[8].tolist(), None)], "v array<double>, s double")
    assert [x[0] for x in asked.select(models.team_of(F.col("v"), F.col("s"), model)).collect()] == ["A", "B", "?", "?", "?", "?"]
    with pytest.raises(ValueError, match="no colour"):
        models.team_colours(df.where("v is null"), "v")
    same = models.team_colours(spark.createDataFrame([([1.0] * 72,)] * 3, "v array<double>"), "v")
    assert same["reject"] == 0.0 and same["centres"][0] == same["centres"][1]
