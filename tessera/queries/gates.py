"""Grids of rules and gates, the gates of labels and bundles, and units of several conditions, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import gates, grids
from tessera.operators.actions import ACTIONS, actions
from tessera.plans.views import OUTCOMES_SQL, outcomes
from tessera.queries.facts import ACTIONS_SQL
from tessera.queries.panel import rounded
from tessera.queries.registry import Registry
from tessera.session import table

Q = Registry()


def _vector_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every action of every vector: sources and strategy add their components to the response."""
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    on = lambda b: F.shiftright(F.col("mask"), b).bitwiseAND(1)
    taken, n = (F.col("strategy") == "RS").cast("int"), F.col("n_sources")
    met = table(spark, d, "embeddings").select("vec_id", "embedding").join(F.broadcast(actions(spark)))
    return met.select(
        "vec_id", "action_id", F.round(F.lit(0.5) + e[0] * on(0) + e[1] * on(1) + e[2] * on(2) + e[3] * taken, 6).alias("response"),
        F.round(F.abs(e[4]) * n / 3, 6).alias("misuse"), F.round(F.abs(e[5]) * (3 - n) / 3, 6).alias("omission"), (40.0 * n + 25 * taken).alias("cost"),
    )


def _rule_grid(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    cards = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rounded(grids.rule_grid(cards, _vector_outcomes(spark, d), "vec_id", {"MP": e[0], "MS": e[1], "ME": e[2]}, e[3]))


_RULES = f"""
    WITH {ACTIONS_SQL}, e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), v AS (SELECT unnest([0.0, 0.04, 0.08, 0.12, 0.18])::DOUBLE AS t),
    o AS (SELECT vec_id, action_id, round(0.5::DOUBLE + x[1] * (mask & 1) + x[2] * ((mask >> 1) & 1) + x[3] * ((mask >> 2) & 1) + x[4] * (strategy = 'RS')::INT, 6) AS response, round(abs(x[5]) * n_sources / 3, 6) AS misuse,
                 round(abs(x[6]) * (3 - n_sources) / 3, 6) AS omission, 40.0::DOUBLE * n_sources + 25 * (strategy = 'RS')::INT AS cost FROM e, actions),
    s AS (SELECT vec_id, a.t AS threshold, b.t AS strategy_threshold, most, x[4] >= b.t AS takes,
                 list_reverse_sort(list_filter([{{'x': x[1], 'n': 'MP', 'bit': 1}}, {{'x': x[2], 'n': 'MS', 'bit': 2}}, {{'x': x[3], 'n': 'ME', 'bit': 4}}], lambda r: r.x >= a.t))[1:most] AS g FROM e, v a, v b, (SELECT unnest([1, 2, 3]) AS most)),
    c AS (SELECT vec_id, threshold, strategy_threshold, most, action_id FROM s JOIN actions ON mask = coalesce(list_sum(list_transform(g, lambda r: r.bit)), 0)::INT AND strategy = CASE WHEN takes THEN 'RS' ELSE 'R0' END),
    h AS (SELECT threshold, strategy_threshold, most, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM (SELECT threshold, strategy_threshold, most, action_id, count(*) AS n FROM c GROUP BY ALL) GROUP BY ALL),
    m AS (SELECT threshold, strategy_threshold, most, count(*) AS cards, count(response) AS covered, round(avg(response), 6) AS response, round(avg(misuse), 6) AS misuse, round(avg(omission), 6) AS omission, round(avg(cost), 6) AS cost
          FROM c LEFT JOIN o USING (vec_id, action_id) GROUP BY ALL),
    r AS (SELECT m.*, round(entropy, 6) AS entropy FROM m JOIN h USING (threshold, strategy_threshold, most))
"""


@Q.query(f"{_RULES} SELECT *, cards = covered AS complete FROM r")
def rule_grid(spark: SparkSession, d: str) -> DataFrame:
    """The rule's 75 settings."""
    return _rule_grid(spark, d)


@Q.query(f"""
    {_RULES}, a AS (SELECT * FROM r WHERE cards = covered QUALIFY response >= max(response) OVER () - 0.02::DOUBLE), b AS (SELECT * FROM a QUALIFY misuse <= min(misuse) OVER () + 0.02::DOUBLE)
    SELECT * FROM b ORDER BY cost, response DESC, misuse, threshold, strategy_threshold, most LIMIT 1
""")
def tuned_rule(spark: SparkSession, d: str) -> DataFrame:
    return grids.best_rule(_rule_grid(spark, d))


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    r, m, o, c = F.round("response", 6), F.round("misuse", 6), F.col("omission"), F.col("cost").cast("double")
    worst = F.greatest(m, o)
    return outcomes(spark, d).select(
        "card_id", "action_id", c.alias("cost"), F.greatest(F.lit(0.0), r - c / 500).alias("quality_lcb"), F.least(F.lit(1.0), r + c / 500).alias("quality_ucb"), worst.alias("risk_ucb"),
        o.alias("memory_omission_ucb"), m.alias("strategy_omission_ucb"), r.alias("quality"), worst.alias("risk"), c.alias("tokens"),
    )


_SETTINGS = ", ".join(f"(SELECT unnest([{', '.join(map(str, v))}])::DOUBLE AS {n})" for n, v in grids.GATED.items())
_GATED = f"""
    WITH {OUTCOMES_SQL}, f AS (SELECT card_id, action_id, split_part(action_id, '+', 1) AS m, split_part(action_id, '+', 2) AS g, round(response, 6) AS q, round(misuse, 6) AS so, omission::DOUBLE AS bo, cost::DOUBLE AS cost FROM outcomes),
    b AS (SELECT *, greatest(0, q - cost / 500) AS lcb, least(1, q + cost / 500) AS uq, greatest(so, bo) AS ucb FROM f),
    t AS (SELECT *, CASE WHEN bool_or(action_id = 'M0+R0') OVER w THEN 'M0+R0' ELSE arg_min(action_id, {{'c': cost, 'a': action_id}}) OVER w END AS base, cost / greatest(max(cost) OVER w, 1) AS share,
                 max(CASE WHEN g = 'R0' THEN uq END) OVER p AS rq, max(CASE WHEN g = 'R0' THEN so END) OVER p AS ro FROM b WINDOW w AS (PARTITION BY card_id), p AS (PARTITION BY card_id, m)),
    u AS (SELECT *, max(CASE WHEN action_id = base THEN uq END) OVER w AS bq, max(CASE WHEN action_id = base THEN bo END) OVER w AS bbo, list_position({sorted(ACTIONS)!r}, action_id) AS place FROM t WINDOW w AS (PARTITION BY card_id)),
    z AS (SELECT *, CASE WHEN m = 'M0' OR bbo >= 0.5 THEN 'infinity'::DOUBLE ELSE round(lcb - bq, 9) END AS memory, CASE WHEN g <> 'RS' OR rq IS NULL OR ro >= 0.5 THEN 'infinity'::DOUBLE ELSE round(lcb - rq, 9) END AS strategy FROM u),
    s AS (SELECT z.*, cost_weight, risk_weight, resource_gain, strategy_gain, max_risk, ucb <= max_risk AND memory >= resource_gain AND strategy >= strategy_gain AS ok, round(lcb - risk_weight * ucb - cost_weight * share, 9) AS utility FROM z, {_SETTINGS}),
    c AS (SELECT card_id, cost_weight, risk_weight, resource_gain, strategy_gain, max_risk, arg_min({{'id': action_id, 'q': q, 'r': ucb, 't': cost, 'ok': ok}},
                 {{'a': (NOT ok)::INT, 'b': CASE WHEN ok THEN 0 ELSE (action_id <> base)::INT END, 'c': -utility, 'd': -lcb, 'e': ucb, 'f': cost, 'g': -place}}) AS v FROM s GROUP BY ALL),
    n AS (SELECT cost_weight, risk_weight, resource_gain, strategy_gain, max_risk, v.id AS id, count(*) AS n, sum(v.q) AS q, sum(v.r) AS r, sum(v.t) AS t, count(*) FILTER (NOT v.ok) AS fb FROM c GROUP BY ALL),
    k AS (SELECT cost_weight, risk_weight, resource_gain, strategy_gain, max_risk, sum(n)::BIGINT AS states, sum(q) / sum(n) AS quality, sum(r) / sum(n) AS risk, sum(t) / sum(n) AS tokens, sum(n) FILTER (id LIKE 'M0+%') / sum(n) AS plain_rate,
                 sum(n) FILTER (id LIKE '%+R0') / sum(n) AS r0_rate, sum(fb) / sum(n) AS fallback_rate, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM n GROUP BY ALL),
    r AS (SELECT cost_weight, risk_weight, resource_gain, strategy_gain, max_risk, states, round(quality, 6) AS quality, round(risk, 6) AS risk, round(tokens, 6) AS tokens, round(coalesce(plain_rate, 0), 6) AS plain_rate, round(coalesce(r0_rate, 0), 6) AS r0_rate,
                 round(fallback_rate, 6) AS fallback_rate, round(entropy, 6) + 0 AS entropy, round(quality - risk_weight * risk - cost_weight * (tokens / (SELECT greatest(avg(cost), 1) FROM f)), 6) AS objective FROM k)
"""


def _gated_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grids.gated_grid(_bounds(spark, d), "card_id"))


@Q.query(f"{_GATED} SELECT * FROM r")
def gated_grid(spark: SparkSession, d: str) -> DataFrame:
    """The gated choice's 432 settings."""
    return _gated_grid(spark, d)


@Q.query(f"{_GATED} SELECT * FROM r WHERE quality >= 0.4 ORDER BY objective DESC, quality DESC, risk, tokens, cost_weight, risk_weight, resource_gain, strategy_gain, max_risk LIMIT 25")
def best_gated(spark: SparkSession, d: str) -> DataFrame:
    """The 25 best settings of those that keep a quality of 0.4."""
    return grids.best_settings(_gated_grid(spark, d), 0.4)


_REGIMES = [*gates.EXPECTED, "other"]


def _labels(spark: SparkSession, d: str) -> DataFrame:
    regime = F.element_at(F.array(*map(F.lit, _REGIMES)), (F.col("card_id") % 10 + 1).cast("int"))
    o = outcomes(spark, d)
    return o.select("card_id", "action_id", F.round("response", 6).alias("quality"), F.greatest(F.round("misuse", 6), "omission").alias("risk"), F.col("cost").cast("double").alias("cost"), (F.col("flag") != "R").alias("reliable"), regime.alias("regime"))


_BEST = f"""
    WITH {OUTCOMES_SQL}, {ACTIONS_SQL}, l AS (SELECT card_id, action_id, round(response, 6) AS q, greatest(round(misuse, 6), omission) AS r, cost::DOUBLE AS cost, flag <> 'R' AS reliable, {_REGIMES!r}[card_id % 10 + 1] AS regime FROM outcomes),
    u AS (SELECT *, round(q - 0.25::DOUBLE * r - 0.1::DOUBLE * (cost / (SELECT greatest(avg(cost), 1) FROM l)), 9) AS u FROM l),
    b AS (SELECT card_id, action_id, regime FROM u QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY u DESC, q DESC, r, cost, action_id DESC) = 1),
    gap AS (SELECT card_id, CASE WHEN len(q) > 1 THEN q[1] - q[2] ELSE 0 END AS gap FROM (SELECT card_id, list_reverse_sort(list(q)) AS q FROM l GROUP BY 1)),
    e AS (SELECT b.*, mask, n_sources, strategy, CASE regime WHEN 'context_only' THEN mask = 0 WHEN 'memory_harmful' THEN mask = 0 WHEN 'profile_needed' THEN mask & 1 > 0 WHEN 'summary_needed' THEN mask & 2 > 0 WHEN 'event_needed' THEN mask & 4 > 0
                 WHEN 'multi_source_needed' THEN n_sources >= 2 WHEN 'strategy_helpful' THEN strategy = 'RS' WHEN 'strategy_harmful' THEN strategy = 'R0' WHEN 'ambiguous' THEN round(gap, 9) <= 0.05 ELSE true END AS passed
          FROM b JOIN gap USING (card_id) JOIN actions USING (action_id)),
    rates AS (SELECT regime, count(*) AS n, avg(passed::INT) AS pass_rate FROM e GROUP BY 1)
"""


@Q.query(f"{_BEST} SELECT regime, n, round(pass_rate, 6) AS pass_rate FROM rates")
def regime_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gates.regime_rates(gates.best_labels(_labels(spark, d), "card_id")))


@Q.query(f"""
    {_BEST}, w AS (SELECT count(*) AS labels, avg(reliable::INT) AS reliable_rate FROM l),
    s AS (SELECT count(*) AS states, count(DISTINCT action_id) AS actions, avg((mask = 0)::INT) AS m0_share, avg((strategy = 'R0')::INT) AS r0_share, avg((strategy = 'RS')::INT) AS rs_share FROM e),
    t AS (SELECT max(n) / sum(n) AS top_share FROM (SELECT count(*) AS n FROM e GROUP BY action_id)),
    g AS (SELECT coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest({[*gates.EXPECTED]!r}) AS x) WHERE x NOT IN (SELECT regime FROM rates)), '') AS missing_regimes,
                 coalesce((SELECT string_agg(regime, ',' ORDER BY regime) FROM rates WHERE regime <> 'other' AND pass_rate < 0.6), '') AS low_regimes),
    f AS (SELECT *, array_to_string(list_filter([CASE WHEN reliable_rate < 0.8 THEN 'reliable_label_rate' END, CASE WHEN actions < 6 THEN 'distinct_oracle_actions' END, CASE WHEN top_share > 0.35 THEN 'single_action_dominance' END,
                 CASE WHEN m0_share < 0.1 THEN 'm0_oracle_coverage' END, CASE WHEN r0_share < 0.15 THEN 'r0_oracle_coverage' END, CASE WHEN rs_share < 0.15 THEN 'rs_oracle_coverage' END,
                 CASE WHEN missing_regimes <> '' THEN 'missing_regimes' END, CASE WHEN low_regimes <> '' THEN 'regime_alignment' END], lambda x: x IS NOT NULL), ',') AS failures FROM w, s, t, g)
    SELECT labels, states, actions, round(reliable_rate, 6) AS reliable_rate, round(top_share, 6) AS top_share, round(m0_share, 6) AS m0_share, round(r0_share, 6) AS r0_share, round(rs_share, 6) AS rs_share, missing_regimes, low_regimes, failures,
           CASE WHEN failures = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM f
""")
def label_gates(spark: SparkSession, d: str) -> DataFrame:
    """The eight gates of a table of labels in one row."""
    return rounded(gates.label_gates(_labels(spark, d), "card_id"))


@Q.query("""
    WITH r AS (SELECT l_orderkey, l_linenumber AS c, min({'f': l_returnflag, 's': l_linestatus, 'c': CASE WHEN l_returnflag = 'N' THEN [] ELSE [l_returnflag, l_linestatus] END, 'p': l_partkey}) AS r, count(*) AS n
               FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1, 2),
    g AS (SELECT a.l_orderkey, a.r AS a, b.r AS b, c.r AS c, a.n AS na, b.n AS nb, c.n AS nc FROM (SELECT * FROM r WHERE c = 1) a LEFT JOIN (SELECT * FROM r WHERE c = 2) b USING (l_orderkey) LEFT JOIN (SELECT * FROM r WHERE c = 3) c USING (l_orderkey))
    SELECT l_orderkey, a.f AS l_returnflag, a.s AS l_linestatus, array_to_string(a.c, ',') AS context, a.p AS first_part, b.p AS second_part, c.p AS third_part,
           array_to_string(list_filter([CASE WHEN b IS NULL THEN '2' END, CASE WHEN c IS NULL THEN '3' END], lambda x: x IS NOT NULL), ',') AS missing,
           array_to_string(list_filter([CASE WHEN na > 1 THEN '1' END, CASE WHEN nb > 1 THEN '2' END, CASE WHEN nc > 1 THEN '3' END], lambda x: x IS NOT NULL), ',') AS repeated,
           array_to_string(list_filter([CASE WHEN b IS NOT NULL AND (a.f, a.s, a.c) IS DISTINCT FROM (b.f, b.s, b.c) THEN '2' END, CASE WHEN c IS NOT NULL AND (a.f, a.s, a.c) IS DISTINCT FROM (c.f, c.s, c.c) THEN '3' END], lambda x: x IS NOT NULL), ',') AS differs
    FROM g
""")
def condition_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of three conditions with a shared context, one of whose lists may be null or empty."""
    flags = F.array("l_returnflag", "l_linestatus")
    context = F.when(F.col("l_returnflag") != "N", flags).when(F.col("l_partkey") % 2 == 0, F.array().cast("array<string>"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("condition"), "l_returnflag", "l_linestatus", context.alias("context"), "l_partkey")
    u = gates.unit_rows(rows, ["l_orderkey"], "condition", ["1", "2", "3"], ["l_returnflag", "l_linestatus", "context"], ["l_partkey"])
    part = lambda c: F.try_element_at("candidates", F.lit(c))["l_partkey"]
    return u.select("l_orderkey", "l_returnflag", "l_linestatus", F.array_join("context", ",").alias("context"), part("1").alias("first_part"), part("2").alias("second_part"), part("3").alias("third_part"), "missing", "repeated", "differs")


@Q.query(f"""
    WITH c AS (SELECT doc_id // 9 AS bundle, CASE WHEN doc_id % 50 = 0 THEN 'context_only' WHEN doc_id % 77 = 0 THEN 'other' ELSE {[*gates.EXPECTED]!r}[doc_id % 9 + 1] END AS regime, lang, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t,
                      doc_id % 13 AS mp, doc_id % 17 AS ms, doc_id % 221 AS me, (doc_id // 9) % 2 AS split FROM documents),
    n AS (SELECT bundle, max(n) AS most FROM (SELECT bundle, t, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1),
    g AS (SELECT bundle, count(*) AS cases, count(DISTINCT regime) AS kinds, count(DISTINCT regime) FILTER (regime <> 'other') AS regimes, count(DISTINCT regime) FILTER (regime IN ('context_only', 'event_needed', 'strategy_helpful', 'strategy_harmful')) AS needed,
                 bool_or(greatest(mp, ms, me) <= 0) AS none, bool_or(least(mp, ms, me) <= 0) AS lacks, bool_or(NOT coalesce(CASE split WHEN 0 THEN lang IN ('en', 'de', 'fr') ELSE lang IN ('en', 'es') END, false)) AS outside FROM c GROUP BY 1)
    SELECT bundle, cases, regimes, array_to_string(list_filter([CASE WHEN most > 1 THEN 'repeated_text' END, CASE WHEN needed < 4 THEN 'missing_regimes' END, CASE WHEN none THEN 'no_inventory' END,
           CASE WHEN NOT (regimes = 9 AND kinds = 9 AND cases = 9) THEN 'one_case_per_regime' END, CASE WHEN outside THEN 'family_outside_pool' END, CASE WHEN lacks THEN 'missing_source' END], lambda x: x IS NOT NULL), ',') AS failures FROM g JOIN n USING (bundle)
""")
def bundle_gates(spark: SparkSession, d: str) -> DataFrame:
    """Six gates of each bundle of nine documents."""
    i = F.col("doc_id")
    regime = F.when(i % 50 == 0, "context_only").when(i % 77 == 0, "other").otherwise(F.element_at(F.array(*map(F.lit, gates.EXPECTED)), (i % 9 + 1).cast("int")))
    bundle = F.floor(i / 9)
    cases = table(spark, d, "documents").select(bundle.alias("bundle"), "text", regime.alias("regime"), F.col("lang").alias("family"), F.when(bundle % 2 == 0, "even").otherwise("odd").alias("split"), (i % 13).alias("MP"), (i % 17).alias("MS"), (i % 221).alias("ME"))
    return gates.bundle_gates(cases, "bundle", {"even": ["en", "de", "fr"], "odd": ["en", "es"]})
