"""Gates over whole tables of labels, units and bundles: a report with what failed, and a check that raises."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_text
from tessera.operators.actions import MEMORY
from tessera.operators.keys import CheckFailed
from tessera.operators.policy import best_rows

#: What the best action of a regime is expected to be.
EXPECTED = {
    "context_only": "m0",
    "profile_needed": "mp",
    "summary_needed": "ms",
    "event_needed": "me",
    "multi_source_needed": "multi",
    "memory_harmful": "m0",
    "strategy_helpful": "rs",
    "strategy_harmful": "r0",
    "ambiguous": "ambiguous",
}
#: Regimes that every bundle must have.
REQUIRED = ("context_only", "event_needed", "strategy_helpful", "strategy_harmful")


def _named(**failed: Column) -> Column:
    """Names of what failed, in the order given, joined by commas; a null condition hasn't failed."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in failed.items()])), ",")


def best_labels(labels: DataFrame, state: str, risk_weight: float = 0.25, cost_weight: float = 0.10) -> DataFrame:
    """Per state: the action of greatest utility, ``regime``, ``utility`` and ``gap`` between the two best qualities.

    Utility is quality less weighted risk and weighted cost as a share of the mean cost of all labels, to nine digits; ties go to
    better quality, lower risk, lower cost, greater id. A state with one action has no gap.
    """
    scale = labels.agg(F.greatest(F.avg("cost"), F.lit(1.0)).alias("_scale"))
    utility = F.round(F.col("quality") - risk_weight * F.col("risk") - cost_weight * (F.col("cost") / F.col("_scale")), 9)
    rows = labels.join(F.broadcast(scale)).select(state, "action_id", "regime", "quality", "risk", "cost", utility.alias("utility"))
    # Ids are few, so that their place in a list makes a number of them that can be negated.
    ids = sorted(f"{m}+{s}" for m in MEMORY.values() for s in ("R0", "RS"))
    place = F.array_position(F.array(*map(F.lit, ids)), F.col("action_id"))
    best = best_rows(rows, [state], [-F.col("utility"), -F.col("quality"), F.col("risk"), F.col("cost"), -place])
    two = F.slice(F.sort_array(F.collect_list("quality"), asc=False), 1, 2)
    gaps = rows.groupBy(state).agg(two.alias("q")).select(state, F.when(F.size("q") > 1, F.col("q")[0] - F.col("q")[1]).otherwise(0.0).alias("gap"))
    return best.join(gaps, state).select(state, "action_id", "regime", "utility", "gap")


def as_expected(regime: Column, action: Column, gap: Column) -> Column:
    """Whether a regime's best action is what the regime asks for; other regimes ask for nothing."""
    memory, strategy = F.split_part(action, F.lit("+"), F.lit(1)), F.split_part(action, F.lit("+"), F.lit(2))
    masks = F.create_map(*[x for m, code in MEMORY.items() for x in (F.lit(code), F.lit(m))])[memory]
    holds = {
        "m0": masks == 0,
        "mp": masks.bitwiseAND(1) > 0,
        "ms": masks.bitwiseAND(2) > 0,
        "me": masks.bitwiseAND(4) > 0,
        "multi": F.bit_count(masks) >= 2,
        "rs": strategy == "RS",
        "r0": strategy == "R0",
        "ambiguous": F.round(gap, 9) <= 0.05,
    }
    out = F.lit(True)
    for name, kind in EXPECTED.items():
        out = F.when(regime == name, holds[kind]).otherwise(out)
    return out


def regime_rates(best: DataFrame) -> DataFrame:
    """``regime, n, pass_rate`` over the rows of ``best_labels``; a null regime is ``unknown``."""
    regime = F.coalesce("regime", F.lit("unknown"))
    passed = as_expected(regime, F.col("action_id"), F.col("gap"))
    return best.groupBy(regime.alias("regime")).agg(F.count("*").alias("n"), F.avg(passed.cast("double")).alias("pass_rate"))


def label_gates(
    labels: DataFrame,
    state: str,
    min_reliable: float = 0.80,
    min_actions: int = 6,
    max_share: float = 0.35,
    min_m0: float = 0.10,
    min_r0: float = 0.15,
    min_rs: float = 0.15,
    min_pass: float = 0.60,
    **weights: float,
) -> DataFrame:
    """One row: what the eight gates of a table of labels measure, ``failures`` by name, and ``status``.

    ``labels`` have ``action_id, quality, risk, cost, reliable, regime`` for each state. Of a state's actions the best one counts
    (``best_labels``); the regimes are those of ``EXPECTED``, of which each must be there and meet ``min_pass``. An empty table fails.
    """
    best = best_labels(labels, state, **weights)
    m0, r0 = F.col("action_id").startswith("M0+"), F.col("action_id").endswith("+R0")
    per_action = best.groupBy("action_id").agg(F.count("*").alias("n"))
    n = F.sum("n")
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / n
    shares = per_action.agg(F.coalesce(n, F.lit(0)).alias("states"), F.count("*").alias("actions"), (F.max("n") / n).alias("top_share"), share(m0).alias("m0_share"), share(r0).alias("r0_share"), share(~r0).alias("rs_share"))
    known = F.array(*map(F.lit, sorted(EXPECTED)))
    rates = regime_rates(best).agg(
        F.array_join(F.array_except(known, F.collect_set("regime")), ",").alias("missing_regimes"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.array_contains(known, F.col("regime")) & (F.col("pass_rate") < min_pass), F.col("regime")))), ",").alias("low_regimes"),
    )
    whole = labels.agg(F.count("*").alias("labels"), F.avg(F.col("reliable").cast("double")).alias("reliable_rate"))
    out = whole.join(F.broadcast(shares)).join(F.broadcast(rates))
    below = lambda c, least: F.coalesce(F.col(c) < least, F.lit(True))
    failures = _named(
        reliable_label_rate=below("reliable_rate", min_reliable),
        distinct_oracle_actions=F.col("actions") < min_actions,
        single_action_dominance=F.col("top_share") > max_share,
        m0_oracle_coverage=below("m0_share", min_m0),
        r0_oracle_coverage=below("r0_share", min_r0),
        rs_oracle_coverage=below("rs_share", min_rs),
        missing_regimes=F.col("missing_regimes") != "",
        regime_alignment=F.col("low_regimes") != "",
    )
    return out.withColumn("failures", failures).withColumn("status", F.when(F.col("failures") == "", "PASS").otherwise("FAIL"))


def require_label_gates(labels: DataFrame, state: str, **limits: float) -> DataFrame:
    """The report of ``label_gates``, if all pass; else it raises with their names."""
    report = label_gates(labels, state, **limits)
    r = report.first()
    if r.failures:
        raise CheckFailed(f"labels fail {r.failures} (missing regimes: {r.missing_regimes or 'none'}; low: {r.low_regimes or 'none'})")
    return report


def unit_rows(turns: DataFrame, unit: Sequence[str], condition: str, conditions: Sequence[str], same: Sequence[str], candidate: Sequence[str]) -> DataFrame:
    """Per unit: what it shares, each condition's candidate, and what is wrong with it.

    ``turns`` have a row per unit and condition; other conditions are passed over. ``same`` columns must agree, null-safely and
    over whole lists (a null list is an empty one), with those of the first of ``conditions``, whose values stand for the unit. Result: the unit,
    ``same``, ``candidates`` (a map from condition to a struct of ``candidate``), and as texts of names joined by commas
    ``missing``, ``repeated`` and ``differs``. Units without the first condition aren't units. A unit's rows, one a condition, meet
    in one aggregate; of repeated ones the least counts.
    """
    kinds = dict(turns.dtypes)
    value = lambda c: F.coalesce(c, F.array().cast(kinds[c])).alias(c) if kinds[c].startswith("array") else F.col(c)
    rows = turns.where(F.col(condition).isin(*conditions)).select(*unit, F.col(condition).alias("_c"), F.struct(*map(value, same)).alias("_same"), F.struct(*candidate).alias("_x"))
    per = rows.groupBy(*unit, "_c").agg(F.min(F.struct("_same", "_x")).alias("_r"), F.count("*").alias("_n"))
    g = per.groupBy(*unit).agg(F.map_from_entries(F.collect_list(F.struct("_c", F.struct("_r", "_n")))).alias("_m"))
    names = F.array(*map(F.lit, conditions))
    at = lambda c: F.try_element_at("_m", c)
    base = F.try_element_at("_m", F.lit(conditions[0]))
    listed = lambda keep: F.array_join(F.filter(names, keep), ",")
    g = g.where(base.isNotNull())
    return g.select(
        *unit,
        *[base["_r"]["_same"][c].alias(c) for c in same],
        F.transform_values("_m", lambda _, v: v["_r"]["_x"]).alias("candidates"),
        listed(lambda c: at(c).isNull()).alias("missing"),
        listed(lambda c: at(c)["_n"] > 1).alias("repeated"),
        listed(lambda c: at(c).isNotNull() & ~at(c)["_r"]["_same"].eqNullSafe(base["_r"]["_same"])).alias("differs"),
    )


def require_units(turns: DataFrame, unit: Sequence[str], condition: str, conditions: Sequence[str], same: Sequence[str], candidate: Sequence[str]) -> DataFrame:
    """The units of ``unit_rows``, if each has every condition once, in the same context; else it raises with some of them."""
    rows = unit_rows(turns, unit, condition, conditions, same, candidate)
    bad = rows.where("missing <> '' OR repeated <> '' OR differs <> ''").select(*unit, "missing", "repeated", "differs").limit(10).collect()
    if bad:
        raise CheckFailed(f"units without every condition once in one context: {[tuple(r) for r in bad]}")
    return rows.drop("missing", "repeated", "differs")


def bundle_gates(cases: DataFrame, bundle: str, pools: Mapping[str, Sequence[str]] | Sequence[str], sources: Sequence[str] = ("MP", "MS", "ME"), strict: bool = True) -> DataFrame:
    """Per bundle: ``cases, regimes`` and ``failures`` by name.

    ``cases`` have ``text, regime, family`` and a count of memories for each source. Gates: ``repeated_text`` (after lower-casing and
    collapsing white space), ``missing_regimes`` (of ``REQUIRED``), ``no_inventory`` (a case without any memory); and if ``strict`` also
    ``one_case_per_regime`` (all of ``EXPECTED``, each once, and no other), ``family_outside_pool`` and ``missing_source`` (a case that lacks one).
    ``pools`` are the allowed families, or those of each split, by the column ``split``. A null regime or family is not allowed.
    """
    inside = lambda names: F.coalesce(F.col("family").isin(*names), F.lit(False))
    if isinstance(pools, Mapping):
        allowed = F.lit(False)
        for split, names in pools.items():
            allowed = F.when(F.col("split") == split, inside(names)).otherwise(allowed)
    else:
        allowed = inside(pools)
    counts = [F.coalesce(F.col(s), F.lit(0)) for s in sources]
    rows = cases.select(
        bundle, "regime", F.md5(normalize_text(F.col("text"))).alias("_t"), allowed.alias("_allowed"), (F.greatest(*counts) <= 0).alias("_none"), (F.least(*counts) <= 0).alias("_lacks")
    )
    # Texts are counted in a stage of their own, so that a bundle's texts need not meet in one task.
    per_text = rows.groupBy(bundle, "_t", "regime").agg(F.count("*").alias("n"), F.max(~F.col("_allowed")).alias("_out"), F.max("_none").alias("_none"), F.max("_lacks").alias("_lacks"))
    texts = per_text.groupBy(F.col(bundle).alias("_b"), "_t").agg(F.sum("n").alias("n")).groupBy("_b").agg(F.max("n").alias("_most"))
    g = per_text.groupBy(bundle, "regime").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("_out", "_none", "_lacks")])
    known = sorted(EXPECTED)
    has = lambda names: F.size(F.array_intersect(F.array(*map(F.lit, names)), F.col("_regimes"))) == len(names)
    g = g.groupBy(bundle).agg(
        F.sum("n").alias("cases"), F.count("*").alias("_kinds"), F.max("n").alias("_per"), F.collect_set(F.when(F.col("regime").isin(*known), F.col("regime"))).alias("_regimes"),
        *[F.max(c).alias(c) for c in ("_out", "_none", "_lacks")],
    )
    checks = {"repeated_text": F.col("_most") > 1, "missing_regimes": ~has(REQUIRED), "no_inventory": F.col("_none")}
    if strict:
        one = has(known) & (F.col("_kinds") == len(known)) & (F.col("_per") == 1)
        checks |= {"one_case_per_regime": ~one, "family_outside_pool": F.col("_out"), "missing_source": F.col("_lacks")}
    return g.join(texts, F.col(bundle).eqNullSafe(F.col("_b"))).select(bundle, "cases", F.size("_regimes").cast("long").alias("regimes"), _named(**checks).alias("failures"))
