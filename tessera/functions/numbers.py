"""Numeric expressions: safe casts, calibrated scores, vectors and the three percentile rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the six response dimensions.
COMPOSITE = {"empathy": 0.30, "fit": 0.20, "guidance": 0.15, "restraint": 0.15, "coherence": 0.10, "safety": 0.10}


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def safe_double(x: Column, default: float | None = None) -> Column:
    """As a double; what is no finite number becomes ``default``."""
    d = x.try_cast("double")
    return F.when(finite(d), d).otherwise(F.lit(default).cast("double"))


def as_unit(x: Column, most: float = 2.0) -> Column:
    """A rating up to ``most`` as a share; anything else is 0."""
    return F.coalesce(x.try_cast("double") / most, F.lit(0.0))


def sigmoid(x: Column, clip: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), x))))


def clip_unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def composite_score(dims: Mapping[str, Column], weights: Mapping[str, float] = COMPOSITE) -> Column:
    """Weighted mean of ratings from 1 to 5, as a share. Weights must be those of the dimensions and sum to 1."""
    if set(dims) != set(weights) or min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must cover the dimensions, be non-negative and sum to 1")
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + w * (dims[name] - 1) / 4
    return out


def interval(mean: Column, std: Column, z: float, lo: float, hi: float) -> tuple[Column, Column]:
    """Mean less and plus ``z`` deviations, within [lo, hi]."""
    clip = lambda x: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    return clip(mean - z * std), clip(mean + z * std)


def violation(value: Column, limit: float) -> Column:
    """How far a value exceeds its limit, relative to it."""
    return F.greatest(F.lit(0.0), value - limit) / max(limit, 1e-6)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def percentile_linear(x: str, q: float) -> Column:
    """Between the neighbours of q · (n - 1)."""
    return F.percentile(x, F.lit(q))


def percentile_lower(df: DataFrame, group: list[str], x: str, q: float, name: str) -> DataFrame:
    """The value at the rank ⌊q · (n - 1)⌋ of each group."""
    w = W.partitionBy(*group)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(x)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.floor(q * (F.col("_n") - 1))).select(*group, F.col(x).alias(name))
