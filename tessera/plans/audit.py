"""Units of a paired audit: the same units under every condition, and the strata that want them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sampling import stratum_candidates
from tessera.session import table

#: The conditions of an audit: the policy, two baselines and one that spends more, as event types stand for them.
CONDITIONS = {"policy": "view", "rule": "click", "fixed": "purchase", "session": "signup"}

#: Units wanted of each stratum, in the order in which they choose.
UNIT_QUOTAS = {"saves_and_holds": 20, "saves_but_lower": 15, "dearer_and_better": 10, "high_use": 5}


def unit_conditions(spark: SparkSession, d: str) -> DataFrame:
    """``unit_id, user_id, condition, tokens, overall`` of the units (user, day modulo 4) judged under all conditions."""
    names = F.create_map(*[F.lit(x) for name, event in CONDITIONS.items() for x in (event, name)])
    e = table(spark, d, "events").where(F.col("event_type").isin(*CONDITIONS.values()))
    unit = F.concat_ws(":", "user_id", F.pmod(F.day("ts"), F.lit(4)))
    hundredths = F.round(F.col("value") * 100).cast("long")
    facts = e.groupBy(unit.alias("unit_id"), "user_id", names[F.col("event_type")].alias("condition")).agg(
        F.max(hundredths).alias("tokens"), (F.pmod(F.sum(hundredths), F.lit(5)) + 1).alias("overall")
    )
    whole = facts.groupBy("unit_id").agg(F.count("*").alias("n")).where(F.col("n") == len(CONDITIONS))
    return facts.join(whole.select("unit_id"), "unit_id")


def unit_strata(facts: DataFrame) -> DataFrame:
    """``unit_id, user_id, stratum, priority``: a unit stands in each stratum whose rule it meets.

    Savings are the most tokens that the policy saves against a baseline. A stratum's priority adds to
    the tokens at stake what the difference in quality weighs (100, 250 and 400 a point).
    """
    of = lambda c, x: F.max(F.when(F.col("condition") == c, F.col(x)))
    wide = facts.groupBy("unit_id", "user_id").agg(*[of(c, x).alias(f"{c}_{x}") for c in CONDITIONS for x in ("tokens", "overall")])
    saved = F.greatest("rule_tokens", "fixed_tokens") - F.col("policy_tokens")
    best = F.col("policy_overall") - F.least("rule_overall", "fixed_overall")
    worst = F.col("policy_overall") - F.greatest("rule_overall", "fixed_overall")
    dearer = F.col("session_tokens") - F.col("policy_tokens")
    better = F.col("session_overall") - F.col("policy_overall")
    strata = {
        "saves_and_holds": ((saved > 0) & (best >= 0), saved + 100 * F.col("policy_overall")),
        "saves_but_lower": ((saved > 0) & (worst < 0), saved - 250 * worst),
        "dearer_and_better": ((dearer > 0) & (better > 0), dearer + 400 * better),
        "high_use": (F.lit(True), F.col("policy_tokens")),
    }
    return stratum_candidates(wide, strata).select("unit_id", "user_id", "stratum", "priority")


_NAMES = " ".join(f"WHEN '{event}' THEN '{name}'" for name, event in CONDITIONS.items())
_WIDE = ", ".join(f"max({x}) FILTER (condition = '{c}') AS {c}_{x}" for c in CONDITIONS for x in ("tokens", "overall"))
UNITS_SQL = f"""unit_facts AS (SELECT user_id || ':' || (day(ts) % 4) AS unit_id, user_id, CASE event_type {_NAMES} END AS condition,
        max(round(value * 100)::BIGINT) AS tokens, (sum(round(value * 100)::BIGINT) % 5 + 1)::BIGINT AS overall FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3),
    unit_conditions AS MATERIALIZED (SELECT unit_id, condition, tokens, overall FROM unit_facts QUALIFY count(*) OVER (PARTITION BY unit_id) = 4),
    wide AS (SELECT unit_id, split_part(unit_id, ':', 1)::BIGINT AS user_id, {_WIDE} FROM unit_conditions GROUP BY 1),
    gaps AS (SELECT *, greatest(rule_tokens, fixed_tokens) - policy_tokens AS saved, policy_overall - least(rule_overall, fixed_overall) AS best,
        policy_overall - greatest(rule_overall, fixed_overall) AS worst, session_tokens - policy_tokens AS dearer, session_overall - policy_overall AS better FROM wide),
    unit_strata AS MATERIALIZED (SELECT unit_id, user_id, 'saves_and_holds' AS stratum, (saved + 100 * policy_overall)::DOUBLE AS priority FROM gaps WHERE saved > 0 AND best >= 0
        UNION ALL SELECT unit_id, user_id, 'saves_but_lower', saved - 250 * worst FROM gaps WHERE saved > 0 AND worst < 0
        UNION ALL SELECT unit_id, user_id, 'dearer_and_better', dearer + 400 * better FROM gaps WHERE dearer > 0 AND better > 0
        UNION ALL SELECT unit_id, user_id, 'high_use', policy_tokens FROM gaps)"""
