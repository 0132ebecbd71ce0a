"""Models: logistic regression, also of all folds side by side, two-colour clusters of several starts, a ranking of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.values import logistic, nearest_centre, squared_distance
from trackmill.operators.common import scratch, written


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 3000, rate: float = 0.1, penalty: float = 1.0) -> dict:
    """Standardised logistic regression by full gradient steps; the bias isn't penalised."""
    mean, std = x.mean(0), x.std(0) + 1e-6
    z, w, b = (x - mean) / std, np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(z @ w + b))) - y
        w -= rate * (z.T @ error + penalty * w) / len(y)
        b -= rate * error.mean()
    return {"mean": mean.tolist(), "std": std.tolist(), "w": w.tolist(), "b": float(b)}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-((x - model["mean"]) / model["std"] @ model["w"] + model["b"])))


def fit_choice(x: np.ndarray, chosen: np.ndarray, group: np.ndarray, rounds: int = 3000, rate: float = 0.1, penalty: float = 1.0) -> dict:
    """A conditional logit over the candidates (rows) of each group, one of them chosen: standardised, by full gradient
    steps. Groups without a chosen row are left out; without any group every weight is 0."""
    order = np.argsort(group, kind="stable")
    x, chosen, group = x[order], chosen[order].astype(float), group[order]
    _, at = np.unique(group, return_inverse=True)
    has = np.bincount(at, chosen) > 0 if len(at) else np.zeros(0, bool)
    keep = has[at]
    x, chosen, at = x[keep], chosen[keep], np.unique(at[keep], return_inverse=True)[1]
    if not len(x):
        return {"mean": [0.0] * x.shape[1], "std": [1.0] * x.shape[1], "w": [0.0] * x.shape[1]}
    mean, std = x.mean(0), x.std(0) + 1e-6
    z, w, starts = (x - mean) / std, np.zeros(x.shape[1]), np.flatnonzero(np.diff(at, prepend=-1))
    for _ in range(rounds):
        u = z @ w
        p = np.exp(u - np.maximum.reduceat(u, starts)[at])
        p /= np.add.reduceat(p, starts)[at]
        w -= rate * (penalty * w + z.T @ (p - chosen)) / len(starts)
    return {"mean": mean.tolist(), "std": std.tolist(), "w": w.tolist()}


def ranked_by_choice(df: DataFrame, by: list[str], row_id: str, features: list[Column], model: dict) -> DataFrame:
    """df with p, each candidate's probability within its key, and its rank; equals (to nine decimals of the utility) go by
    row_id. A null feature counts as the mean."""
    from pyspark.sql import Window

    terms = [F.coalesce((f.cast("double") - m) / s * w, F.lit(0.0)) for f, m, s, w in zip(features, *(map(float, model[k]) for k in ("mean", "std", "w")))]
    over = Window.partitionBy(*by)
    rows = df.withColumn("_u", sum(terms, F.lit(0.0)))
    rows = rows.withColumn("_e", F.exp(F.col("_u") - F.max("_u").over(over)))
    return rows.withColumn("p", F.col("_e") / F.sum("_e").over(over)).withColumn("rank", F.row_number().over(over.orderBy(F.desc(F.round("_u", 9)), row_id))).drop("_u", "_e")


def _summed(rows: DataFrame, per_batch: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The sums over all rows of what per_batch gives for each Arrow batch: arrays of fixed sizes, added up in each task, then
    over the tasks element by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for k, v in per_batch(b).items():
                    total[k] = total[k] + v if k in total else v
        flat = [(k, i, float(v)) for k, array in total.items() for i, v in enumerate(np.ravel(array))]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["k", "i", "v"])

    found: dict[str, dict[int, float]] = {}
    for k, i, v in rows.mapInArrow(run, "k string, i int, v double").groupBy("k", "i").agg(F.sum("v")).collect():
        found.setdefault(k, {})[i] = v
    return {k: np.array([d[i] for i in range(len(d))]) for k, d in found.items()}


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def fit_by_fold(df: DataFrame, fold: str, features: str, label: str, *, penalty: float = 1.0, rounds: int | None = None, rate: float = 0.1, tolerance: float = 1e-10, most: int = 100) -> dict:
    """For each fold the model of fit_logistic's loss over the rows of all other folds, and under the key ... that over all rows.

    All models are fitted side by side. Means, deviations and counts are sums by fold, of which "all but one" is a difference.
    A step is one pass over the rows in which a batch's rows meet all models in one matrix product; a row counts for those
    whose fold isn't its own. Rows are never repeated, and what comes back is as large as the models are. With rounds, the
    steps are fit_logistic's own gradient steps, so many of them; else they are Newton's, which reach the least loss in a
    few passes (until no weight moves by more than `tolerance`, at most `most`). If no other rows exist, all weights are 0.
    Rows without features or a label are left out; a null fold is one more fold. As many numbers are sent as folds times
    features (squared, by Newton's steps), so folds have to be few: videos, not rows. The rows are written once, below
    spark.checkpoint.dir.
    """
    rows = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(fold).cast("string").alias("fold"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    rows = written(rows, f"{scratch(df.sparkSession)}/rows")
    names = sorted((r["fold"] for r in rows.select("fold").distinct().collect()), key=lambda v: (v is not None, v or ""))
    number, folds = {n: i for i, n in enumerate(names)}, len(names)
    if not folds:
        return {}

    def moments(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        x, at = _matrix(b.column(1)), np.array([number[f] for f in b.column(0).to_pylist()])
        one = np.zeros((folds, len(at)))
        one[at, np.arange(len(at))] = 1
        return {"n": one.sum(1), "sum": one @ x}

    def others(by_fold: np.ndarray) -> np.ndarray:
        """Sums over all folds but each one, and over all."""
        return np.concatenate([by_fold.sum(0, keepdims=True) - by_fold, by_fold.sum(0, keepdims=True)])

    sums = _summed(rows, moments)
    n, width = others(sums["n"].reshape(folds, 1)), len(sums["sum"]) // folds
    some = n[:, 0] > 0
    mean = others(sums["sum"].reshape(folds, width)) / np.maximum(n, 1)
    centre = sums["sum"].reshape(folds, width).sum(0) / max(sums["n"].sum(), 1)  # near the means, so that squares don't cancel

    def squares(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        x, at = _matrix(b.column(1)) - centre, np.array([number[f] for f in b.column(0).to_pylist()])
        one = np.zeros((folds, len(at)))
        one[at, np.arange(len(at))] = 1
        return {"square": one @ (x * x)}

    square = others(_summed(rows, squares)["square"].reshape(folds, width)) / np.maximum(n, 1)
    std = np.sqrt(np.maximum(square - (mean - centre) ** 2, 0)) + 1e-6
    w = np.zeros((folds + 1, width + 1))  # the bias comes last

    def step(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        x, y, at = _matrix(b.column(1)), b.column(2).to_numpy(), np.array([number[f] for f in b.column(0).to_pylist()])
        grad, curve = np.zeros((folds + 1, width + 1)), np.zeros((folds + 1, width + 1, width + 1))
        for k in range(folds + 1):
            z = np.column_stack([(x - mean[k]) / std[k], np.ones(len(x))])[at != k]
            p = 1 / (1 + np.exp(-(z @ w[k])))
            grad[k] = z.T @ (p - y[at != k])
            if rounds is None:
                curve[k] = (z * (p * (1 - p))[:, None]).T @ z
        return {"grad": grad, "curve": curve} if rounds is None else {"grad": grad}

    shrink = np.append(np.full(width, float(penalty)), 0.0)
    for _ in range(rounds if rounds is not None else most):
        got = _summed(rows, step)
        grad = got["grad"].reshape(w.shape) + shrink * w
        if rounds is not None:
            w = w - rate * grad / np.maximum(n, 1)
            continue
        curve = got["curve"].reshape(folds + 1, width + 1, width + 1) + np.diag(shrink + 1e-12)
        move = np.where(some[:, None], np.linalg.solve(curve + np.where(some, 0.0, 1.0)[:, None, None] * np.eye(width + 1), grad[..., None])[..., 0], 0.0)
        w = w - move * np.minimum(1.0, 4.0 / np.maximum(np.abs(move).max(1, keepdims=True), 1e-300))
        if np.abs(move).max() <= tolerance:
            break
    return {name: {"mean": mean[k].tolist(), "std": std[k].tolist(), "w": w[k, :-1].tolist(), "b": float(w[k, -1])} for k, name in enumerate([*names, ...])}


def leave_one_out(df: DataFrame, fold: str, features: str, label: str, penalty: float = 1.0, rounds: int | None = None) -> DataFrame:
    """(fold, n, right): how many rows of each fold the model of all others gets right (see fit_by_fold); rows without features
    count as 0, a missed shot that never crossed the rim. Scoring is a column of literals chosen by the fold, without a join."""
    fitted = fit_by_fold(df, fold, features, label, penalty=penalty, rounds=rounds)
    x, name = F.col(features), F.col(fold).cast("string")
    score = F.lit(None).cast("double")
    for f, m in fitted.items():
        if f is not ...:
            p = logistic([F.get(x, F.lit(i)).cast("double") for i in range(len(m["w"]))], m["mean"], m["std"], m["w"], m["b"])
            score = F.when(name.eqNullSafe(F.lit(f)), p).otherwise(score)
    said = F.coalesce(score > 0.5, F.lit(False)) & x.isNotNull()
    return df.where(F.col(label).isNotNull()).select(name.alias("fold"), (said == (F.col(label).cast("double") > 0.5)).alias("ok")).groupBy("fold").agg(F.count("*").alias("n"), F.count_if("ok").alias("right"))


def colour_clusters(rows: DataFrame, starts: int = 10, rounds: int = 100, least_move: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, float]:
    """(centres, cost): of `starts` runs of two-means over rows (v: arrays of doubles) the one whose squared distances add up to least.

    All runs go side by side: a pass over the rows meets the centres of all of them in one product and adds up each
    cluster's rows; runs that stand still (no centre moves by least_move) rest. Each run's first centre is a row drawn
    evenly, its second one drawn in proportion to the squared distance from it: the row with the least -ln(u) / weight,
    u from a hash of the row's numbers and the run, so draws don't depend on the order of rows.
    """
    v = F.col("v")
    u = lambda s: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(s), F.to_json(F.struct("v"))), 11).cast("double") + 1.0) / float(1 << 53)
    firsts = rows.agg(*(F.min_by(v, F.struct(u(2 * s), v)).alias(f"c{s}") for s in range(starts))).first()
    weight = lambda s: squared_distance(v, F.array(*(F.lit(float(x)) for x in firsts[s])))
    if firsts[0] is None:
        raise ValueError("there is no colour to cluster")
    drawn = lambda s: F.when(weight(s) > 0, F.struct(-F.log(u(2 * s + 1)) / weight(s), v))  # noqa: E731  null at the first centre
    seconds = rows.agg(*(F.min_by(v, drawn(s)).alias(f"c{s}") for s in range(starts))).first()  # null if all rows stand there
    centres = np.array([[a, b if b is not None else a] for a, b in zip(firsts, seconds)], float)
    cost, on = np.full(starts, np.inf), np.ones(starts, bool)
    for _ in range(rounds + 1):
        live = np.flatnonzero(on)

        def near(b: pa.RecordBatch) -> dict[str, np.ndarray]:
            x, c = _matrix(b.column(0)), centres[live].reshape(2 * len(live), -1)
            far = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0).reshape(len(x), len(live), 2)
            side = far.argmin(2)
            count, total = np.zeros((len(live), 2)), np.zeros((len(live), 2, x.shape[1]))
            for k in (0, 1):
                count[:, k], total[:, k] = (side == k).sum(0), (side == k).astype(float).T @ x
            return {"cost": far.min(2).sum(0), "count": count, "total": total}

        got = _summed(rows, near)
        count, total = got["count"].reshape(-1, 2, 1), got["total"].reshape(len(live), 2, -1)
        moved = np.where(count > 0, total / np.maximum(count, 1), centres[live])
        cost[live] = got["cost"]
        still = np.sqrt(((moved - centres[live]) ** 2).sum(2)).max(1) <= least_move
        centres[live] = moved
        on[live[still]] = False
        if not on.any():
            break
    best = int(np.argmin(np.round(cost, 9)))
    return centres[best], float(cost[best])


def team_colours(df: DataFrame, vector: str, bins: int = 18, seed: int = 1, starts: int = 10, share: float = 0.975, room: float = 1.25, least_saturated: float = 0.15) -> dict:
    """Two centres of colour vectors, A the one whose strongest hue comes first; `reject`, the distance beyond which neither
    fits: room times the percentile `share` of the distances from the nearest centre; and the least share of saturated
    pixels. Null vectors are left out. The vectors are written once below spark.checkpoint.dir."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    rows = written(rows, f"{scratch(df.sparkSession)}/colours")
    found, _ = colour_clusters(rows, starts, seed=seed)
    hue = lambda c: int(np.asarray(c).reshape(bins, -1).sum(1).argmax())
    centres = sorted((c.tolist() for c in found), key=lambda c: (hue(c), c))
    far = F.least(*(F.sqrt(squared_distance(F.col("v"), F.array(*(F.lit(float(x)) for x in c)))) for c in centres))
    return {"centres": centres, "reject": rows.agg(F.percentile(far, share)).first()[0] * room, "least_saturated": least_saturated}


def team_of(vector: Column, saturated: Column, model: dict) -> Column:
    """A or B by the nearest centre; '?' for a null vector, one beyond the distance, or too few saturated pixels."""
    near = nearest_centre(vector, model["centres"], ["A", "B"], model["reject"])
    return F.when(saturated.isNull() | (saturated < model["least_saturated"]), "?").otherwise(near)


def batch_scores(df: DataFrame, image: str, load, classes: int) -> DataFrame:
    """df with probs: load() gives a model in each task, which turns a list of images (bytes) into rows of probabilities.

    A batch is an Arrow batch (spark.sql.execution.arrow.maxRecordsPerBatch); null images have null probs.
    """

    def run(parts):
        model = load()
        for rows in parts:
            known = rows[image].notna()
            probs = pd.Series([None] * len(rows), index=rows.index, dtype=object)
            if known.any():
                found = np.asarray(model(rows[image][known].tolist()), float).reshape(-1, classes)
                probs[known] = pd.Series(found.tolist(), index=rows.index[known], dtype=object)
            yield rows.assign(probs=probs)

    return df.mapInPandas(run, df.select("*", F.lit(None).cast("array<double>").alias("probs")).schema)
