"""Choices on busy keys: blocks and rounds against plain loops."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from trackmill.operators import choices, matching, sequences


def plain_chain(rows, touching):
    out, last = [], {}
    for k, a, z in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if k not in last or a > last[k] or touching and a == last[k]:
            out.append((k, a, z))
            last[k] = z
    return sorted(out, key=str)


@pytest.mark.parametrize("touching", [False, True])
@pytest.mark.parametrize("block", [1, 7, 64, 100_000])
def test_chains(spark, touching, block):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(r.choice([None, 1, 1, 1, 2, 3]), a := r.randint(0, 300), a + r.choice([-1, 0, 1, 5, 40, 200])) for _ in range(250)]
        found = choices.chained(spark.createDataFrame(rows, "k int, a long, z long").repartition(3), ["k"], "a", "z", touching, block=block)
        assert sorted(map(tuple, found.collect()), key=str) == plain_chain(rows, touching)


def test_chains_of_other_types(spark):
    rows = [("a", "x", f"2024-01-01 00:0{i}:00", f"2024-01-01 00:0{i + 1}:30") for i in range(8)]
    df = spark.createDataFrame(rows, "k string, v string, a string, z string").selectExpr("k", "v", "cast(a as timestamp) a", "cast(z as timestamp) z")
    assert choices.chained(df, ["k", "v"], "a", "z", False, block=2).count() == 4
    assert choices.chained(df.limit(0), ["k"], "a", "z", False).count() == 0
    assert choices.chained(df.selectExpr("k", "a", "cast(null as timestamp) z"), ["k"], "a", "z", False).count() == 0
    assert choices.chained(df.selectExpr("k", "date(a) a", "date(z) z"), ["k"], "a", "z", False).count() == 1


def test_one_busy_key_takes_linear_time(spark):
    took = []
    for n in (100_000, 1_000_000):
        rows = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 10 + F.pmod(F.col("id") * 7, F.lit(25))).alias("z"))
        begin = time.perf_counter()
        found = sequences.suppress_overlaps(rows, ["k"], "a", "z")
        assert "collect_list" not in found._jdf.queryExecution().toString()
        kept = [r.a for r in found.select("a").orderBy("a").collect()] if n == 100_000 else found.count()
        took.append(time.perf_counter() - begin)
        if n == 100_000:
            assert kept == [a for _, a, _ in sorted(plain_chain([(1, 10 * i, 10 * i + 10 + i * 7 % 25) for i in range(n)], False), key=lambda x: x[1])]
    assert took[1] < 12 * took[0]


def plain_peaks(rows, least, apart):
    out = []
    for k in {k for k, *_ in rows}:
        best, kept = {}, []
        for key, at, s in rows:
            if key == k and s >= least:
                best[at] = max(s, best.get(at, s))
        for at in sorted(best, key=lambda a: (-best[a], a)):
            i = bisect.bisect(kept, at)
            if (i == 0 or at - kept[i - 1] > apart) and (i == len(kept) or kept[i] - at > apart):
                kept.insert(i, at)
        out += [(k, at, best[at]) for at in kept]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 25, 100_000])
def test_peaks(spark, block):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(r.choice([1, 1, 1, 2, None]), r.randint(0, 400), float(r.randint(0, 30))) for _ in range(260)]
        found = choices.peaks(spark.createDataFrame(rows, "k int, at long, score double").repartition(3), ["k"], "at", "score", 4.0, 6, block=block)
        assert sorted(map(tuple, found.collect()), key=str) == plain_peaks(rows, 4.0, 6)


@pytest.mark.parametrize(("slope", "block"), [(1, choices.BLOCK), (1, 2000), (-1, 5000), (0, 5000)])
def test_peaks_of_a_long_line(spark, slope, block, monkeypatch):
    """Each choice depends on the one before, all the way; the rounds stay few."""
    rounds, n = [], 100_000
    keep = choices.written
    monkeypatch.setattr(choices, "written", lambda df, path: (rounds.append(path), keep(df, path))[1])
    rows = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") * slope + n).cast("double").alias("score"))
    found = choices.peaks(rows, ["k"], "id", "score", 0.0, 1, block=block)
    assert [r.id for r in found.orderBy("id").collect()] == list(range(1, n, 2) if slope > 0 else range(0, n, 2))
    assert len(rounds) < 40


def test_peaks_that_all_reach_each_other(spark):
    found = choices.peaks(spark.range(3000).select(F.lit(1).alias("k"), "id", (F.col("id") % 997).cast("double").alias("score")), ["k"], "id", "score", 0.0, 10_000, block=100)
    assert [(r.id, r.score) for r in found.collect()] == [(996, 996.0)]


def plain_pairs(pairs):
    out, left, right = [], set(), set()
    for d, k, i, j in sorted((d, k, i, j) for k, i, j, d in pairs):
        if (k, i) not in left and (k, j) not in right:
            left.add((k, i))
            right.add((k, j))
            out.append((k, i, j, d))
    return sorted(out)


@pytest.mark.parametrize("block", [5, 60, 100_000])
def test_pairs(spark, block):
    for seed in range(3):
        r = random.Random(seed)
        gt, pred = ([(r.choice([1, 1, 2]), i, r.randint(0, 500)) for i in range(120)] for _ in range(2))
        pairs = [(k, i, j, abs(t - u), t) for k, i, t in gt for m, j, u in pred if k == m and abs(t - u) <= 12]
        found = choices.pairs_one_to_one(spark.createDataFrame(pairs, "k int, i int, j int, d long, at long").repartition(3), ["k"], "i", "j", "d", "at", block=block)
        assert sorted(tuple(x)[:4] for x in found.collect()) == plain_pairs([p[:4] for p in pairs])


def test_pairs_of_a_long_chain(spark):
    """Distances fall along the axis, so that each pair waits for the next one."""
    n = 20_000
    gt = spark.range(n).select(F.lit(1).alias("v"), F.col("id").alias("i"), (F.col("id") * 4000.0 - F.col("id") * F.col("id") * 0.01).alias("t"))
    pred = spark.range(n).select(F.lit(1).alias("v"), F.col("id").alias("j"), (F.col("id") * 4000.0 + 1990 - F.col("id") * F.col("id") * 0.01 - F.col("id") * 0.001).alias("u"))
    found = matching.one_to_one(gt, pred, ["v"], "i", "j", "t", "u", 2100.0)
    t, u = [i * 4000.0 - i * i * 0.01 for i in range(n)], [i * 4000.0 + 1990 - i * i * 0.01 - i * 0.001 for i in range(n)]
    pairs = [(1, i, j, abs(u[j] - t[i])) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n and abs(u[j] - t[i]) <= 2100]
    assert sorted((r.v, r.i, r.j) for r in found.collect()) == [x[:3] for x in plain_pairs(pairs)]
