"""The two chains from labelled actions to choices: a ranker with ridge heads, and bootstrapped ensembles with gates."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.boosting import boosted
from tessera.operators.features import group_weights
from tessera.operators.keys import SENT_KEYS, CheckFailed
from tessera.operators.logistic import fit_columns, log_loss
from tessera.operators.models import ridge_fits
from tessera.operators.pairgraph import pair_rows, won_differences
from tessera.session import durable

BASELINE = "M0+R0"
#: Heads of the first chain beside the ranker's ``response``; each is learned and given in [0, 1].
HEADS = ("misuse", "omission", "memory_quality", "strategy_risk", "strategy_quality")
#: Ratings of the second chain, from 1 to 5, and its risks, from 0 to 3.
RATINGS = ("empathy", "fit", "guidance", "restraint", "coherence", "helpfulness")
RISKS = ("misuse", "memory_omission", "exposure", "stale", "unsupported", "strategy_omission", "premature")


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def _linear(features: Sequence[str], weights: Sequence[float], bias: float = 0.0) -> Column:
    out = F.lit(float(bias))
    for f, w in zip(features, weights, strict=True):
        out = out + float(w) * F.col(f)
    return out


@dataclass
class ActionModel:
    """Weights of six heads over the same features, and the range in which they were learned."""

    features: list[str]
    ranker: list[float]
    heads: dict[str, list[float]]
    low: dict[str, float]
    high: dict[str, float]
    report: dict = field(default_factory=dict)

    def out_of_range(self, rows: DataFrame, slack: float = 1e-12) -> dict:
        """Share of values outside the learned range, the largest margin in units of the range, and whether that is severe."""
        span = {f: max(self.high[f] - self.low[f], 1e-9) for f in self.features}
        over = {f: F.greatest(self.low[f] - F.col(f), F.col(f) - self.high[f], F.lit(0.0)) for f in self.features}
        out = sum(((over[f] > slack).cast("double") for f in self.features), F.lit(0.0)) / len(self.features)
        r = rows.agg(F.avg(out).alias("outside"), F.max(F.greatest(*[over[f] / span[f] for f in self.features], F.lit(0.0))).alias("margin")).first()
        outside, margin = r.outside or 0.0, r.margin or 0.0
        return {"outside": outside, "margin": margin, "severe": outside > 0.1 or margin > 1}

    def score_actions(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``response`` (a sigmoid of the clipped logit) and the five heads in [0, 1]; fails where the input is severely out of range.

        Values slightly out of range are cut to it. All heads are expressions, so nothing is shuffled.
        """
        report = self.out_of_range(rows)
        if report["severe"]:
            raise CheckFailed(f"input outside the learned range: {report}")
        cut = rows.withColumns({f"_x_{f}": _clip(F.col(f), self.low[f], self.high[f]) for f in self.features})
        x = [f"_x_{f}" for f in self.features]
        cols = {"response": 1 / (1 + F.exp(-_clip(_linear(x, self.ranker), -30.0, 30.0)))}
        cols |= {h: _clip(_linear(x, w[1:], w[0]), 0.0, 1.0) for h, w in self.heads.items()}
        return cut.withColumns(cols).drop(*x)


def train_actions(
    actions: DataFrame, pairs: DataFrame, card: str, train: Column, features: Sequence[str], state: str | None = None, c: float = 1.0, alpha: float = 5.0, made: DataFrame | None = None
) -> ActionModel:
    """Fit the ranker on decided pairs and the five heads on labelled actions of the rows where ``train`` holds.

    Gates, each of which fails the training: no training card; a ``state`` on both sides of the split;
    an action without one of the labels; pairs of fewer than two classes. A card's actions weigh 1
    together. The ranker's penalty is that of an inverse strength ``c`` over summed losses, the ridge's
    ``alpha``; both leave out the intercept, which mirrored pairs make zero. ``made`` are the pairs' rows
    (``pair_rows``) where the caller has them.
    """
    features = list(features)
    split = actions.withColumn("_t", F.coalesce(train, F.lit(False)))
    missing = [F.count_if(F.col("_t") & F.col(h).isNull()).alias(h) for h in HEADS]
    seen = split.agg(F.count_distinct(F.when(F.col("_t"), F.col(card))).alias("cards"), *missing).first()
    if not seen.cards:
        raise CheckFailed("no training card")
    if any(seen[h] for h in HEADS):
        raise CheckFailed(f"labels are incomplete: { {h: seen[h] for h in HEADS if seen[h]} }")
    if state and not split.groupBy(state).agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).where("lo <> hi").isEmpty():
        raise CheckFailed(f"{state}: on both sides of the split")
    rows = group_weights(split.where("_t"), card)
    ends = rows.agg(*[f(x).alias(f"{n}_{x}") for x in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    p = (made if made is not None else durable(pair_rows(pairs, actions, card, features))).join(rows.select(card).distinct(), card, "left_semi")
    p = durable(p.select("label", "weight", *features))
    total = p.agg(F.count_distinct("label").alias("k"), F.count("*").alias("n")).first()
    if total.k < 2:
        raise CheckFailed("pairs have fewer than two classes")
    ranker = fit_columns(p, features, c=c)
    heads = {h: [float(v) for v in b] for h, b in ridge_fits(rows, features, HEADS, "weight", alpha).items()}
    report = {"cards": seen.cards, "pairs": total.n // 2}
    return ActionModel(features, [float(v) for v in ranker], heads, {f: float(ends[f"lo_{f}"]) for f in features}, {f: float(ends[f"hi_{f}"]) for f in features}, report)


def evaluate_actions(model: ActionModel, actions: DataFrame, pairs: DataFrame, card: str, made: DataFrame | None = None) -> DataFrame:
    """One row: decided ``pairs``, ``accuracy`` and ``log_loss`` of the ranker on them, and the mean absolute error of each head on ``actions``."""
    z = _linear(model.features, model.ranker)
    p = (made if made is not None else pair_rows(pairs, actions, card, model.features)).select("label", (1 / (1 + F.exp(-_clip(z, -30.0, 30.0)))).alias("q"))
    ranked = p.agg((F.count("*") / 2).cast("long").alias("pairs"), F.avg(((F.col("q") > 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy"), F.avg(log_loss(F.col("label"), F.col("q"))).alias("log_loss"))
    errors = [F.avg(F.abs(_clip(_linear(model.features, w[1:], w[0]), 0.0, 1.0) - F.col(h))).alias(f"mae_{h}") for h, w in model.heads.items()]
    return ranked.join(F.broadcast(actions.agg(*errors)))


def cross_validated(actions: DataFrame, pairs: DataFrame, folds: DataFrame, card: str, state: str, modes: Mapping[str, Sequence[str]], strengths: Sequence[float] = (1.0,)) -> DataFrame:
    """``mode, c, fold`` and what ``evaluate_actions`` says of a model that ``train_actions`` would fit on the other folds; ``folds`` has ``state, fold``.

    The grid is the caller's, and small. All its heads are fitted from one pass over the actions and judged by
    another. Pairs are made once; those of equal differences and folds fall together with their weights, which
    changes no sum, and the rankers' steps pass what is left. A pair and its mirror image have the same loss, so one
    of them is kept.
    """
    names = sorted({f for some in modes.values() for f in some})
    few = durable(folds.select(state, "fold"))
    rows = actions.join(F.broadcast(few) if few.count() <= SENT_KEYS else few, state)
    every = sorted(r[0] for r in few.select("fold").distinct().collect())
    sums = _fold_sums(rows, card, names, every)
    for f in every:
        if not sums[f]["cards"]:
            raise CheckFailed("no training card")
        if any(sums[f][f"missing_{h}"] for h in HEADS):
            raise CheckFailed(f"labels are incomplete: { {h: sums[f][f'missing_{h}'] for h in HEADS if sums[f][f'missing_{h}']} }")
    if not rows.groupBy(state).agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).where("lo <> hi").isEmpty():
        raise CheckFailed(f"{state}: on both sides of the split")
    won = won_differences(pairs, rows, card, names, _folds=F.sort_array(F.collect_set("fold")))
    won = durable(won.groupBy("_folds", *names).agg(F.sum("weight").alias("weight"), F.count("*").alias("n")))
    judged, errors = [], []
    for k, ((mode, features), c) in enumerate(itertools.product(modes.items(), strengths)):
        models = {}
        for f in every:
            p = won.where(F.exists("_folds", lambda x: x != f)).select(F.lit(1.0).alias("label"), (2 * F.col("weight")).alias("weight"), *features)
            if p.isEmpty():
                raise CheckFailed("pairs have fewer than two classes")
            models[f] = [float(v) for v in fit_columns(p, features, c=c)], _ridge_of(sums[f], names, features, 5.0)
        chosen = lambda of: F.coalesce(*[F.when(F.col("fold") == f, of(m)) for f, m in models.items()])  # noqa: B023, E731
        z = _clip(chosen(lambda m: _linear(features, m[0])), -30.0, 30.0)  # noqa: B023
        held = won.select(F.explode("_folds").alias("fold"), "n", *features).select("fold", "n", (1 / (1 + F.exp(-z))).alias("q"), (1 / (1 + F.exp(z))).alias("r"))
        n, known = F.sum("n"), 2 * F.sum(F.when(F.col("q").isNotNull(), F.col("n")))
        right = F.sum(F.col("n") * ((F.col("q") > 0.5).cast("double") + (F.col("r") <= 0.5).cast("double"))) / known
        loss = F.sum(F.col("n") * (log_loss(F.lit(1.0), F.col("q")) + log_loss(F.lit(0.0), F.col("r")))) / known
        judged.append(held.groupBy("fold").agg(n.alias("pairs"), right.alias("accuracy"), loss.alias("log_loss")).withColumn("k", F.lit(k)))
        at = [F.avg(F.abs(_clip(chosen(lambda m: _linear(features, m[1][h][1:], m[1][h][0])), 0.0, 1.0) - F.col(h))).alias(f"mae_{h}") for h in HEADS]  # noqa: B023
        errors.append((k, at))
    flat = rows.groupBy("fold").agg(*[e.alias(f"{k}_{h}") for k, at in errors for h, e in zip(HEADS, at, strict=True)])
    maes = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"{k}_{h}").alias(f"mae_{h}") for h in HEADS]) for k, _ in errors])
    maes = flat.select("fold", F.explode(maes).alias("e")).select("fold", "e.*")
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(mode).alias("mode"), F.lit(float(c)).alias("c"), F.lit(f).alias("fold")) for k, (mode, c) in enumerate(itertools.product(modes, strengths)) for f in every])
    out = rows.sparkSession.range(1).select(F.explode(grid).alias("e")).select("e.*").join(reduce(DataFrame.unionByName, judged), ["k", "fold"], "left").join(maes, ["k", "fold"], "left")
    return out.select("mode", "c", "fold", F.coalesce("pairs", F.lit(0)).alias("pairs"), "accuracy", "log_loss", *[f"mae_{h}" for h in HEADS])


def _fold_sums(rows: DataFrame, card: str, features: Sequence[str], folds: Sequence) -> dict:
    """For each of ``folds`` the sums that ridge fits on the rows of the others need, with each card's rows there weighing 1 together, and the rows' numbers of cards and missing labels."""
    w = W.partitionBy(card)
    others = rows.select(card, "fold", *features, *HEADS, *[F.count_if(F.col("fold") != f).over(w).alias(f"_m{i}") for i, f in enumerate(folds)])
    each = F.array(*[F.when(F.col("fold") != f, F.struct(F.lit(f).alias("f"), F.col(f"_m{i}").alias("m"))) for i, f in enumerate(folds)])
    per = others.select(card, *features, *HEADS, F.explode(F.array_compact(each)).alias("_e")).withColumn("_w", 1.0 / F.col("_e.m"))
    x = {"": F.lit(1.0)} | {f: F.col(f) for f in features}
    products = {f"{a} {b}": F.col("_w") * x[a] * x[b] for a, b in itertools.combinations_with_replacement(x, 2)} | {f"{a} y {h}": F.col("_w") * x[a] * F.col(h) for a in x for h in HEADS}
    found = per.groupBy(F.col("_e.f").alias("f")).agg(F.count(card).alias("cards"), *[F.count_if(F.col(h).isNull()).alias(f"missing_{h}") for h in HEADS], *[F.sum(v).alias(k) for k, v in products.items()]).collect()
    return {f: {"cards": 0} for f in folds} | {r["f"]: r.asDict() for r in found}


def _ridge_of(sums: Mapping[str, float], names: Sequence[str], features: Sequence[str], alpha: float) -> dict[str, list[float]]:
    """Each head's weights (intercept first, not penalised) on some of the features, from ``_fold_sums``."""
    x, order = ["", *features], ["", *names]
    at = lambda a, b: sums[" ".join(sorted((a, b), key=order.index))]
    matrix = np.array([[at(a, b) for b in x] for a in x], float) + alpha * np.diag([0.0] + [1.0] * len(features))
    return {h: [float(v) for v in np.linalg.solve(matrix, np.array([sums[f"{a} y {h}"] for a in x], float))] for h in HEADS}


def train_ensembles(rows: DataFrame, state: str, features: Sequence[str], members: int = 7, trees: int = 180, reliable: str = "reliable", seed: int = 17, **kw) -> DataFrame:
    """``state, action_id, head, mean, std``: thirteen bootstrapped ensembles' predictions for all rows, ratings and risks as shares.

    They learn from reliable rows only; each state that has one must have a reliable baseline action, no
    action may stand twice, and there must be three states. Each head's members are drawn by state, and
    all heads and members are fitted together (``boosting.boosted``, which takes further arguments).
    """
    usable = rows.where(F.col(reliable))
    seen = usable.groupBy(state).agg(F.max((F.col("action_id") == BASELINE).cast("int")).alias("base"), F.count("*").alias("n"), F.count_distinct("action_id").alias("k"))
    gate = seen.agg(F.count("*").alias("states"), F.count_if(F.col("base") == 0).alias("bad"), F.count_if(F.col("n") != F.col("k")).alias("twice")).first()
    if not gate.states:
        raise CheckFailed("no reliable labels")
    if gate.bad or gate.twice:
        raise CheckFailed(f"{gate.bad} states without a labelled {BASELINE}, {gate.twice} with an action twice")
    if gate.states < 3:
        raise CheckFailed("a group bootstrap needs three states")
    weighed = group_weights(usable, state).select(state, "action_id", "weight")
    share = {h: (F.col(h) - lo) / span for heads, lo, span in ((RATINGS, 1.0, 4.0), (RISKS, 0.0, 3.0)) for h in heads}
    x = rows.join(weighed, [state, "action_id"], "left").withColumns({f"_y_{h}": y for h, y in share.items()})
    x = durable(x.select(state, "action_id", *features, "weight", *[f"_y_{h}" for h in share]))
    heads = {h: (f"_y_{h}", seed) for h in RATINGS} | {h: (f"_y_{h}", seed + 101) for h in RISKS}
    model = boosted(x, state, features, heads, "weight", members, trees, **kw)
    return model.predict(x).select(state, "action_id", F.explode("predictions").alias("p")).select(state, "action_id", "p.*")


def action_bounds(predictions: DataFrame, state: str, composite: Mapping[str, float], z: float = 1.0) -> DataFrame:
    """``state, action_id, quality_mean, quality_lcb, quality_ucb, risk_ucb, memory_omission_ucb, strategy_omission_ucb`` from predictions per head.

    Bounds are ``z`` deviations about the mean, within [0, 1]; quality is the composite of the ratings'
    shares, risk the largest upper bound.
    """
    if set(composite) != set(RATINGS) or abs(sum(composite.values()) - 1) > 1e-9:
        raise ValueError("the composite must weigh each rating, and sum to 1")
    weight = F.create_map(*[v for h, w in composite.items() for v in (F.lit(h), F.lit(float(w)))])
    p = predictions.withColumn("lo", _clip(F.col("mean") - z * F.col("std"), 0.0, 1.0)).withColumn("hi", _clip(F.col("mean") + z * F.col("std"), 0.0, 1.0))
    rating = F.col("head").isin(*RATINGS)
    quality = lambda c: F.sum(F.when(rating, F.col(c) * weight[F.col("head")]))
    of = lambda h: F.max(F.when(F.col("head") == h, F.col("hi")))
    return p.groupBy(state, "action_id").agg(
        quality("mean").alias("quality_mean"),
        quality("lo").alias("quality_lcb"),
        quality("hi").alias("quality_ucb"),
        F.max(F.when(~rating, F.col("hi"))).alias("risk_ucb"),
        of("memory_omission").alias("memory_omission_ucb"),
        of("strategy_omission").alias("strategy_omission_ucb"),
    )


def gate_terms(bounds: DataFrame, state: str, fallback: str = BASELINE) -> DataFrame:
    """What the gates hold an action against, whatever their settings: bounds of the baseline (``_bq``, ``_bo``) and of the action
    without its strategy (``_rq``, ``_ro``), share of the state's greatest cost (``_cost``), and whether it is the fallback (``_fall``)."""
    w = W.partitionBy(state)
    memory, strategy = F.split_part("action_id", F.lit("+"), F.lit(1)), F.split_part("action_id", F.lit("+"), F.lit(2))
    s = bounds.withColumn("_m", memory).withColumn("_g", strategy)
    cheapest = F.min_by("action_id", F.struct("cost", "action_id")).over(w)
    s = s.withColumn("_cheap", cheapest).withColumn("_base", F.coalesce(F.max(F.when(F.col("action_id") == BASELINE, F.col("action_id"))).over(w), F.col("_cheap")))
    at = lambda c, cond, win: F.max(F.when(cond, F.col(c))).over(win)
    base, plain = F.col("action_id") == F.col("_base"), F.col("_g") == "R0"
    pair = W.partitionBy(state, "_m")
    s = s.withColumns(
        {
            "_bq": at("quality_ucb", base, w),
            "_bo": at("memory_omission_ucb", base, w),
            "_rq": at("quality_ucb", plain, pair),
            "_ro": at("strategy_omission_ucb", plain, pair),
            "_cost": F.col("cost") / F.greatest(F.max("cost").over(w), F.lit(1.0)),
        }
    )
    return s.withColumn("_fall", F.col("action_id") == F.coalesce(F.max(F.when(F.col("action_id") == fallback, F.col("action_id"))).over(w), F.col("_cheap")))


def gated_choice(
    bounds: DataFrame,
    state: str,
    severe: Column | None = None,
    max_risk: float = 0.5,
    resource_gain: float = 0.02,
    memory_trigger: float = 0.5,
    strategy_gain: float = 0.02,
    strategy_trigger: float = 0.5,
    risk_weight: float = 0.5,
    cost_weight: float = 0.1,
    fallback: str = BASELINE,
) -> DataFrame:
    """One row per state: ``action_id``, ``utility`` and ``reason`` (chosen, ``ood`` or ``no action passed``).

    ``bounds`` are rows of ``action_bounds`` with ``cost``. An action may be chosen if its risk bound holds; if it
    reads memory, its lower quality must beat the baseline's upper one, or the baseline's omission
    bound must reach the trigger; if it takes a strategy, the same against the action without it, where there is one.
    Of these the greatest utility (lower quality less weighted risk and share of the greatest cost),
    then quality, lower risk, lower cost, greater id. ``severe`` states, and those where nothing passes,
    get the fallback action, or the cheapest one without it. Gains and utilities are compared to nine digits,
    so that a gain just as large as asked for passes and ties are ties in any engine.
    """
    s = gate_terms(bounds if severe is None else bounds.withColumn("_severe", severe), state, fallback)
    w = W.partitionBy(state)
    s = s.withColumn("_severe", F.coalesce("_severe", F.lit(False)) if severe is not None else F.lit(False))
    resource = (F.col("_m") == "M0") | (F.round(F.col("quality_lcb") - F.col("_bq"), 9) >= resource_gain) | (F.col("_bo") >= memory_trigger)
    strategic = (F.col("_g") != "RS") | F.col("_rq").isNull() | (F.round(F.col("quality_lcb") - F.col("_rq"), 9) >= strategy_gain) | (F.col("_ro") >= strategy_trigger)
    s = s.withColumn("utility", F.round(F.col("quality_lcb") - risk_weight * F.col("risk_ucb") - cost_weight * F.col("_cost"), 9))
    s = s.withColumn("_ok", (F.col("risk_ucb") <= max_risk) & resource & strategic & ~F.col("_severe"))
    best = F.row_number().over(w.orderBy(F.col("_ok").desc(), F.when(~F.col("_ok"), F.col("_fall")).desc(), F.col("utility").desc(), F.col("quality_lcb").desc(), F.col("risk_ucb"), F.col("cost"), F.col("action_id").desc()))
    reason = F.when(F.col("_severe"), "ood").when(F.col("_ok"), "chosen").otherwise("no action passed")
    return s.withColumn("_r", best).where("_r = 1").select(state, "action_id", "utility", reason.alias("reason"))
