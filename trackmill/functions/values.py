"""Parsing, ratios, rounding, votes and scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, null where b is 0."""
    value = F.try_divide(a.cast("double"), b.cast("double"))
    return value if digits is None else F.round(value, digits)


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.1f%%", value * 100))


def integers_in(text: Column) -> Column:
    """All integers of a string, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda v: v.cast("int"))


def pairs_in(text: Column) -> Column:
    """A map from the `key: value` integer pairs of a string, whatever stands between them; of equal keys the last wins."""
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)\s*:\s*(\d+)"), F.lit(1)), lambda v: v.cast("int"))
    values = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)\s*:\s*(\d+)"), F.lit(2)), lambda v: v.cast("int"))
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(keys, i + F.lit(2), F.size(keys)), lambda k: k == e["k"]))
    return F.map_from_entries(last)


def flag(text: Column) -> Column:
    """True for 1, true, yes and y in any case; blank is false."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y"), F.lit(False))


def or_default(text: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), default)


def typed(text: Column) -> Column:
    """A struct of what a string can be read as: nothing, a flag, a number, or itself."""
    blank = F.nullif(text, F.lit(""))
    return F.struct(F.when(blank.isin("True", "False"), blank == "True").alias("flag"), blank.try_cast("double").alias("number"), blank.alias("text"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def frame_at(seconds: Column, fps: Column) -> Column:
    return half_up(seconds * fps).cast("int")


def class_name(number: Column) -> Column:
    return F.format_string("b%02d", number.cast("int"))


def class_number(name: Column) -> Column:
    return F.substring(name, 2, 10).try_cast("int")


def circular_distance(a: Column, b: Column, period: float = 180.0) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(d, period - d)


def logistic(features: list[Column], mean: list[float], std: list[float], w: list[float], b: float) -> Column:
    """Probability of a logistic model whose parameters are literals of the plan."""
    z = F.lit(float(b))
    for f, m, s, k in zip(features, mean, std, w):
        z = z + (f - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(k))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, v: s + v)


def nearest_centre(vector: Column, centres: list[list[float]], names: list[str], reject: float | None = None) -> Column:
    """The name of the nearest centre, the first of equals; '?' beyond reject."""
    best = F.least(*(F.struct(F.sqrt(squared_distance(vector, F.array(*(F.lit(float(v)) for v in c)))).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (c, n) in enumerate(zip(centres, names))))
    return F.when(vector.isNull() | ((best["d"] > reject) if reject is not None else F.lit(False)), "?").otherwise(best["n"])


def renormalised(probs: Column, allowed: Column | None = None) -> Column:
    """Class probabilities over the allowed class numbers only, adding up to one."""
    kept = probs if allowed is None else F.transform(probs, lambda p, i: F.when(F.array_contains(allowed, i.cast("int")), p).otherwise(0.0))
    total = F.greatest(F.aggregate(kept, F.lit(0.0), lambda s, v: s + v), F.lit(1e-9))
    return F.transform(kept, lambda v: v / total)
