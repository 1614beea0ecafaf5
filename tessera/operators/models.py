"""Models on Spark: a pair ranker, ridge heads and bootstrapped trees."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ids import hash_int
from tessera.operators.boosting import boosted
from tessera.operators.logistic import fit_columns, log_loss
from tessera.operators.pairgraph import decided_pairs, pair_rows
from tessera.session import durable


def held_out(group: str, folds: int = 5) -> F.Column:
    return hash_int(F.lit("fold"), group) % folds == 0


def rank_metrics(df: DataFrame, group: str, features: Sequence[str], target: str, c: float = 1.0) -> DataFrame:
    """``n, accuracy, log_loss`` on the pairs of held-out groups of a ranker fitted on those of the others.

    Pairs are the edges of the pair graph between a group's actions, where one side has the greater
    ``target``; each stands with its mirror image.
    """
    x = durable(pair_rows(decided_pairs(df, group, target), df, group, features))
    w = fit_columns(x.where(~held_out(group)), features, c=c)
    p = 1 / (1 + F.exp(-sum((float(v) * F.col(f) for v, f in zip(w, features, strict=True)), F.lit(0.0))))
    right = ((p > 0.5) == (F.col("label") == 1)).cast("double")
    return x.where(held_out(group)).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(log_loss(F.col("label"), p)).alias("log_loss"))


def ridge_fits(df: DataFrame, features: Sequence[str], targets: Sequence[str], weight: str, alpha: float) -> dict[str, np.ndarray]:
    """Weights (intercept first, not penalised) for each target, from sums that combine on the way: one aggregate, one row to the driver."""
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    w, k = F.col(weight), len(features) + 1
    sums = [F.sum(w * a * b) for a in x for b in x] + [F.sum(w * a * F.col(t)) for t in targets for a in x]
    row = np.array(df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first(), dtype=float)
    penalty = alpha * np.eye(k)
    penalty[0, 0] = 0
    matrix = row[: k * k].reshape(k, k) + penalty
    return {t: np.linalg.solve(matrix, row[k * (k + i) : k * (k + i + 1)]) for i, t in enumerate(targets)}


def ridge_metrics(df: DataFrame, group: str, features: Sequence[str], targets: Sequence[str], alpha: float = 5.0) -> DataFrame:
    """``head, n, mae`` on held-out groups, predictions clipped to [0, 1]."""
    rows = df.withColumn("_w", 1.0 / F.count("*").over(W.partitionBy(group)))
    fits = ridge_fits(rows.where(~held_out(group)), features, targets, "_w", alpha)
    out = None
    for t, b in fits.items():
        guess = F.lit(float(b[0]))
        for f, v in zip(features, b[1:], strict=True):
            guess = guess + float(v) * F.col(f)
        guess = F.greatest(F.lit(0.0), F.least(F.lit(1.0), guess))
        row = rows.where(held_out(group)).agg(F.lit(t).alias("head"), F.count("*").alias("n"), F.avg(F.abs(guess - F.col(t))).alias("mae"))
        out = row if out is None else out.unionByName(row)
    return out


def bootstrap_predictions(df: DataFrame, group: str, features: Sequence[str], target: str, members: int = 7, seed: int = 17, trees: int = 180, weight: str | None = None, **kw) -> DataFrame:
    """``group, action_id, mean, std`` (population) over trees boosted on group bootstraps (``boosting.boosted``). Rows of no ``weight`` are predicted only."""
    rows = durable(df)
    model = boosted(rows, group, features, {target: (target, seed)}, weight, members, trees, **kw)
    return model.predict(rows).select(group, "action_id", F.col("predictions")[0]["mean"].alias("mean"), F.col("predictions")[0]["std"].alias("std"))
