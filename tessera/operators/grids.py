"""Whole grids of a policy's settings, evaluated on labelled actions in one pass over the cards."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.chain import gate_terms
from tessera.operators.policy import near_best_then_cheap, strong_rule
from tessera.session import durable, prepare

#: Settings that the rule is tuned over, and those of the gated choice.
RULE_THRESHOLDS, RULE_SOURCES = (0.0, 0.04, 0.08, 0.12, 0.18), (1, 2, 3)
GATED = {
    "cost_weight": (0.05, 0.10, 0.20, 0.30),
    "risk_weight": (0.15, 0.25, 0.40),
    "resource_gain": (-0.03, -0.01, 0.0, 0.02),
    "strategy_gain": (-0.02, 0.0, 0.02),
    "max_risk": (0.30, 0.40, 0.50),
}
METRICS = ("response", "misuse", "omission", "cost")


def rule_grid(
    cards: DataFrame, outcomes: DataFrame, card: str, scores: Mapping[str, Column], confidence: Column, thresholds: Sequence[float] = RULE_THRESHOLDS, most: Sequence[int] = RULE_SOURCES
) -> DataFrame:
    """Metrics of ``strong_rule`` for each threshold of the sources, of the strategy, and most number of sources.

    One row per setting: ``threshold, strategy_threshold, most, cards``, ``covered`` (cards that have a row for the chosen action),
    means of ``METRICS`` over those, and ``entropy`` of the actions in bits; ``complete`` where all cards are covered. A card's
    outcomes, at most sixteen, meet it once, as a map; settings are tried in an array of the row, so neither cards nor
    outcomes are multiplied before sums are combined.
    """
    by_action = outcomes.groupBy(card).agg(F.map_from_entries(F.collect_list(F.struct("action_id", F.struct(*METRICS)))).alias("_outcomes"))
    met = cards.select(card, *[s.cast("double").alias(f"_s{n}") for n, s in scores.items()], confidence.cast("double").alias("_c")).join(by_action, card, "left")
    grid = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.lit(m).alias("m")) for t, s, m in itertools.product(thresholds, thresholds, most)])

    def tried(g: Column) -> Column:
        action = strong_rule({n: F.col(f"_s{n}") for n in scores}, F.col("_c"), g["t"], g["m"], g["s"])
        return F.struct(g["t"].alias("threshold"), g["s"].alias("strategy_threshold"), g["m"].alias("most"), action.alias("action_id"), F.try_element_at("_outcomes", action).alias("o"))

    setting = ["threshold", "strategy_threshold", "most"]
    rows = met.select(F.explode(F.transform(grid, tried)).alias("r")).select("r.*")
    sums = rows.groupBy(*setting, "action_id").agg(F.count("*").alias("n"), F.count("o").alias("k"), *[F.sum(f"o.{c}").alias(c) for c in METRICS])
    n, k = F.sum("n"), F.sum("k")
    entropy = F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n
    return sums.groupBy(*setting).agg(n.alias("cards"), k.alias("covered"), *[F.try_divide(F.sum(c), k).alias(c) for c in METRICS], entropy.alias("entropy"), (n == k).alias("complete"))


def best_rule(grid: DataFrame, slack: float = 0.02) -> DataFrame:
    """The setting that near-best response, then near-least misuse, then cost decide, of those that cover all cards; at most one row."""
    named = grid.where("complete").withColumn("action_id", F.struct("threshold", "strategy_threshold", "most"))
    return near_best_then_cheap(named, [], slack).where("most IS NOT NULL").drop("action_id", "complete")


def gated_grid(bounds: DataFrame, state: str, settings: Mapping[str, Sequence[float]] = GATED, memory_trigger: float = 0.5, strategy_trigger: float = 0.5, states_per_task: int = 20_000) -> DataFrame:
    """Metrics of the gated choice for every combination of five settings, on the labels of the chosen actions.

    ``bounds`` are rows of ``action_bounds`` with ``cost`` and what was observed: ``quality, risk, tokens``. One row per setting: the
    settings, ``states``, means of what was observed, ``plain_rate`` (no memory read), ``r0_rate``, ``fallback_rate``, ``entropy`` of the
    actions in bits, and ``objective``: quality less weighted risk and weighted tokens as a share of their mean over all labels.
    Rows with a null state are left out. Utilities are compared to nine digits. Each state's rows are gathered to one where they lie, ``states_per_task`` states are tried
    at once, and what leaves a task is a row of sums for each setting and action.
    """
    names = list(GATED)
    grid = list(itertools.product(*[settings[n] for n in names]))
    prepare(bounds.sparkSession)
    bounds = bounds.where(F.col(state).isNotNull())
    terms = gate_terms(bounds, state)
    free = lambda c, open_: F.when(open_, F.lit(float("inf"))).otherwise(F.round(c, 9))
    memory = free(F.col("quality_lcb") - F.col("_bq"), (F.col("_m") == "M0") | (F.col("_bo") >= memory_trigger))
    strategy = free(F.col("quality_lcb") - F.col("_rq"), (F.col("_g") != "RS") | F.col("_rq").isNull() | F.coalesce(F.col("_ro") >= strategy_trigger, F.lit(False)))
    numbers = {"lcb": F.col("quality_lcb"), "ucb": F.col("risk_ucb"), "share": F.col("_cost"), "est": F.col("cost"), "memory": memory, "strategy": strategy, "fall": F.col("_fall"), "quality": F.col("quality"), "risk": F.col("risk"), "tokens": F.col("tokens")}
    listed = terms.groupBy(state).agg(F.collect_list(F.struct("action_id", *[c.cast("double").alias(n) for n, c in numbers.items()])).alias("rows")).select("rows")
    parts_of, sums_of = list(numbers), ["n", "fallbacks", "quality", "risk", "tokens"]

    def tried(lists: list[pa.Array]) -> Iterator[tuple]:
        size = np.concatenate([pc.list_value_length(x).to_numpy() for x in lists])
        rows = pa.concat_arrays([x.flatten() for x in lists])
        named = pc.fill_null(rows.field("action_id"), "None").dictionary_encode()
        actions, place_of = np.unique(named.dictionary.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        code = place_of[named.indices.to_numpy()]
        column = {c: rows.field(c).to_numpy(zero_copy_only=False) for c in parts_of}
        n, places, a = len(size), int(size.max()), len(actions)
        # In the order in which ties of utility are settled, so that the first of the greatest is the choice.
        row = np.repeat(np.arange(n), size)
        order = np.lexsort((-code, column["est"], column["ucb"], -column["lcb"], row))
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        x = {c: np.full((places, n), -np.inf if c in ("memory", "strategy") else 0.0) for c in parts_of}
        for c in parts_of:
            x[c][place, row] = column[c][order]
        chosen = np.zeros((places, n), int)
        chosen[place, row] = code[order]
        fall = x["fall"].argmax(axis=0)[None]
        # A gate's array has 0 where an action passes, so that the least of places and gates, or'ed, is the first action that passes all.
        kind = np.uint8 if places < 255 else np.uint16 if places < 65_535 else np.uint32
        top, at, each = np.iinfo(kind).max, np.arange(places, dtype=kind)[:, None], np.arange(n)
        barred = lambda ok: np.where(ok, kind(0), top)
        closed = {(mg, sg, mr): barred((x["memory"] >= mg) & (x["strategy"] >= sg) & (x["ucb"] <= mr)) for mg, sg, mr in itertools.product(*[settings[c] for c in names[2:]])}
        k = 0
        for cw, rw in itertools.product(settings["cost_weight"], settings["risk_weight"]):
            u = np.round(x["lcb"] - rw * x["ucb"] - cw * x["share"], 9)
            best = np.argsort(np.where(np.isnan(u), -np.inf, -u), axis=0, kind="stable")
            taken = np.concatenate([best, fall])
            acts = np.take_along_axis(chosen, taken, 0)
            acts[-1] += a
            seen = [np.take_along_axis(x[c], taken, 0).ravel() for c in ("quality", "risk", "tokens")]
            acts, rank = acts.ravel(), np.empty(best.shape, kind)
            np.put_along_axis(rank, best, np.broadcast_to(at, best.shape), 0)
            for gate in closed.values():
                first = np.minimum(np.minimum.reduce(gate | rank, axis=0), kind(places)).astype(np.int64) * n + each
                picked = acts[first]
                counts, *sums = (np.bincount(picked, w, 2 * a).reshape(2, a) for w in (None, *[v[first] for v in seen]))
                for i in np.flatnonzero(counts.sum(axis=0)):
                    yield k, actions[i], float(counts[:, i].sum()), float(counts[1, i]), *[float(v[:, i].sum()) for v in sums]
                k += 1
        known = rows.field("tokens").drop_null()
        yield -1, "", float(len(known)), 0.0, 0.0, 0.0, float(known.to_numpy().sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = {}, []

        def add() -> None:
            for k, action, *sums in tried(held):
                total[k, action] = total.get((k, action), 0.0) + np.array(sums)
            held.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, states_per_task):
                held.append(batch.column(0).slice(i, states_per_task))
                if sum(map(len, held)) >= states_per_task:
                    add()
        if sum(map(len, held)):
            add()
        if total:
            k, action = zip(*total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(action, pa.string()), *map(pa.array, np.array(list(total.values())).T)], ["k", "action_id", *sums_of])

    parts = durable(listed.mapInArrow(run, "k long, action_id string, " + ", ".join(f"{c} double" for c in sums_of)))
    found = parts.where("k < 0").agg(F.sum("n").alias("n"), F.sum("tokens").alias("t")).first()
    scale, parts = max(found.t / found.n if found.n else 0.0, 1.0), parts.where("k >= 0")
    by_action = parts.groupBy("k", "action_id").agg(*[F.sum(c).alias(c) for c in sums_of])
    n = F.sum("n")
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0.0)) / n
    metrics = by_action.groupBy("k").agg(
        n.cast("long").alias("states"), *[(F.sum(c) / n).alias(c) for c in ("quality", "risk", "tokens")], share(F.col("action_id").startswith("M0+")).alias("plain_rate"),
        share(F.col("action_id").endswith("+R0")).alias("r0_rate"), (F.sum("fallbacks") / n).alias("fallback_rate"), (F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias("entropy"),
    )
    keys = bounds.sparkSession.createDataFrame([(k, *map(float, g)) for k, g in enumerate(grid)], "k long, " + ", ".join(f"{n} double" for n in names))
    objective = F.col("quality") - F.col("risk_weight") * F.col("risk") - F.col("cost_weight") * (F.col("tokens") / scale)
    return F.broadcast(keys).join(metrics, "k").drop("k").withColumn("objective", objective)


def best_settings(grid: DataFrame, minimum_quality: float | None = None, best: int = 25) -> DataFrame:
    """The ``best`` rows of ``gated_grid`` by objective, then quality, lower risk, lower tokens, and the settings in order; those below ``minimum_quality`` are out."""
    kept = grid if minimum_quality is None else grid.where(F.col("quality") >= minimum_quality)
    return kept.orderBy(F.desc("objective"), F.desc("quality"), "risk", "tokens", *GATED).limit(best)
