"""Joins of outcomes with labels and costs, jobs, grids and label merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import actions as act
from tessera.operators import labels as lab
from tessera.operators import panel as p
from tessera.plans.views import OUTCOMES_SQL, SCORES_SQL, outcomes, scores
from tessera.queries.panel import rounded
from tessera.queries.registry import Registry
from tessera.session import table

Q = Registry()

_ACTIONS = ", ".join(f"('{act.action_id(m, s)}', '{act.MEMORY[m]}', {m}, {m.bit_count()}, '{s}')" for m in act.MEMORY for s in act.STRATEGIES)
ACTIONS_SQL = f"actions(action_id, mem_code, mask, n_sources, strategy) AS (VALUES {_ACTIONS})"


@Q.query(f"WITH {OUTCOMES_SQL} SELECT card_id, action_id, round(response, 6) AS response, round(misuse, 6) AS misuse, omission, cost, flag, available, user_id FROM outcomes")
def outcome_facts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(outcomes(spark, d))


@Q.query(f"""
    WITH {OUTCOMES_SQL}, {ACTIONS_SQL} SELECT mem_code, strategy, n_sources::BIGINT AS n_sources, count(*) AS n, count(*) FILTER (mask & available = mask) AS legal,
        round(avg(bit_count(xor(mask, available))), 6) AS mean_difference FROM outcomes JOIN actions USING (action_id) GROUP BY 1, 2, 3
""")
def action_dimension(spark: SparkSession, d: str) -> DataFrame:
    rows = act.parsed(outcomes(spark, d), "action_id")
    g = rows.groupBy("mem_code", "strategy", F.col("n_sources").cast("long").alias("n_sources"))
    legal = act.is_subset(F.col("mask"), F.col("available"))
    return rounded(g.agg(F.count("*").alias("n"), F.count_if(legal).alias("legal"), F.avg(act.symmetric_difference(F.col("mask"), F.col("available"))).alias("mean_difference")))


_LABELS = "l AS (SELECT doc_id AS card_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy(F.col("doc_id").alias("card_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


@Q.query(f"WITH {OUTCOMES_SQL}, {_LABELS} SELECT card_id, action_id, quality, toxic, cost FROM outcomes JOIN l USING (card_id)")
def labelled_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return lab.labelled(outcomes(spark, d).select("card_id", "action_id", "cost"), _labels(spark, d), ["card_id"])


@Q.query(f"WITH {OUTCOMES_SQL}, {_LABELS} SELECT card_id, 'missing label' AS reason FROM outcomes WHERE card_id NOT IN (SELECT card_id FROM l)")
def label_failures(spark: SparkSession, d: str) -> DataFrame:
    return lab.labelled_strict(outcomes(spark, d).select("card_id", "action_id"), _labels(spark, d), ["card_id"])[1]


@Q.query(f"""
    WITH {ACTIONS_SQL}, s AS (SELECT o_orderkey AS card_id, (o_orderkey % 8)::INT AS available FROM orders)
    SELECT card_id, action_id, seed FROM s, actions, (SELECT unnest([17, 29, 43]) AS seed) WHERE mask & available = mask
""")
def variance_jobs(spark: SparkSession, d: str) -> DataFrame:
    """States by legal actions by seeds: both lists are exploded in each row; nothing is crossed."""
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("card_id"), F.pmod("o_orderkey", F.lit(8)).cast("int").alias("available"))
    jobs = s.select("card_id", F.explode(act.allowed_actions(F.col("available"))).alias("action_id"))
    return jobs.withColumn("seed", F.explode(F.array(*map(F.lit, (17, 29, 43)))))


@Q.query(f"""
    WITH {ACTIONS_SQL}, o AS (SELECT DISTINCT l_orderkey AS card_id, (l_orderkey % 8)::INT AS a, (l_partkey % 8)::INT AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'RS' ELSE 'R0' END AS s, l_linenumber AS n FROM lineitem)
    SELECT card_id, n, b, f.action_id AS fixed, m.action_id AS memory, c.action_id AS whole, r.action_id AS rule FROM o
    JOIN actions f ON f.mask = 7 & a AND f.strategy = 'RS' JOIN actions m ON m.mask = a | b AND m.strategy = s
    JOIN actions c ON c.mask = a | b AND c.strategy = CASE WHEN s = 'RS' OR b % 2 = 1 THEN 'RS' ELSE 'R0' END JOIN actions r ON r.mask = b AND r.strategy = s
""")
def combined_actions(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.pmod("l_orderkey", F.lit(8)).cast("int"), F.pmod("l_partkey", F.lit(8)).cast("int")
    s = F.when(F.col("l_linenumber") % 2 == 0, "RS").otherwise("R0")
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("card_id"), a.alias("a"), b.alias("b"), s.alias("s"), F.col("l_linenumber").alias("n")).distinct()
    t = F.when(F.col("b") % 2 == 1, "RS").otherwise("R0")
    args = (F.col("a"), F.col("s"), F.col("b"), t)
    return o.select(
        "card_id",
        "n",
        "b",
        act.fixed_action(7, "RS", F.col("a")).alias("fixed"),
        act.combined(*args, "memory").alias("memory"),
        act.combined(*args, "both").alias("whole"),
        act.combined(*args, "rule").alias("rule"),
    )


@Q.query("""
    SELECT n_name, r_name, count(*) AS customers, sum(orders)::BIGINT AS orders FROM (
      SELECT c_custkey, n_name, r_name, count(o_orderkey) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Children are counted under their key before parents are looked up, so that the join sees each parent once."""
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    c = table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["orders"])
    c = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"))


@Q.query("""
    SELECT conv_id, turn, 'obs_' || o AS observation FROM conversations, (SELECT unnest([1, 2, 3]) AS o) WHERE role = 'assistant'
""")
def observation_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    return rows.withColumn("observation", F.explode(F.array(*[F.lit(f"obs_{i}") for i in (1, 2, 3)])))


@Q.query(f"""
    WITH {SCORES_SQL}, n AS (SELECT unit, variant, condition, max(risk) AS unsupported, max(exposure) AS missed, min(exposure) AS appropriate FROM scores WHERE condition = 'view' GROUP BY 1, 2, 3),
    m AS (SELECT unit, variant, condition, max(greatest(risk % 3, exposure, position) / 2) AS misuse, min((2 - exposure) / 2) AS quality FROM scores WHERE condition IN ('click', 'error') GROUP BY 1, 2, 3),
    b AS (SELECT unit, variant, condition, max(risk % 3) / 2 AS s, max(2 - exposure) / 2 AS q FROM scores WHERE condition = 'click' GROUP BY 1, 2, 3)
    SELECT unit, variant, condition, unsupported / 2 AS misuse, greatest(missed / 2, 1 - appropriate / 2) AS omission, appropriate / 2 AS quality FROM n
    UNION ALL SELECT unit, variant, condition, misuse, greatest(0, coalesce(s, 0)), least(quality, coalesce(q, quality)) FROM m LEFT JOIN b USING (unit, variant, condition)
""")
def memory_labels(spark: SparkSession, d: str) -> DataFrame:
    k = ["unit", "variant", "condition"]
    s = scores(spark, d)
    m0 = s.where("condition = 'view'").groupBy(*k).agg(F.max("risk").alias("unsupported"), F.max("exposure").alias("missed"), F.min("exposure").alias("appropriate"))
    m2 = s.where("condition in ('click', 'error')").select(*k, (F.col("risk") % 3).alias("unused"), "exposure", F.col("position").alias("stale"), (2 - F.col("exposure")).alias("appropriate"))
    m2b = s.where("condition = 'click'").groupBy(*k).agg(F.max(F.col("risk") % 3).alias("severity"), F.max(2 - F.col("exposure")).alias("sufficiency"))
    return lab.memory_labels(m0, m2, m2b, k)


@Q.query(f"""
    WITH {SCORES_SQL} SELECT event_id, greatest(risk, exposure) / 2 AS risk, (rating + second) / 4 AS quality FROM scores WHERE position = 0
    UNION ALL SELECT event_id, greatest(risk / 2, exposure / 2, 1 - position / 2), position / 2 FROM scores WHERE position = 1
""")
def strategy_labels(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    use = s.where("position = 0").select("event_id", F.col("risk").alias("over"), F.col("exposure").alias("premature"), F.col("rating").alias("relevance"), F.col("second").alias("used"))
    out = s.where("position = 1").select("event_id", F.col("risk").alias("missed"), F.col("exposure").alias("inappropriate"), F.col("position").alias("appropriate"))
    return lab.strategy_labels(use, out, ["event_id"])


@Q.query(f"""
    WITH {SCORES_SQL} SELECT condition, round(coalesce(avg(CASE WHEN exposure = 2 THEN (risk > 1)::INT END), 0), 9) AS recall,
        round(coalesce(sum(exposure / 2 * (risk > 1)::INT) / sum(exposure / 2), 0), 9) AS weighted, round(avg((risk > 1)::INT), 9) AS use FROM scores GROUP BY 1
""")
def observation_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).select("condition", (F.col("exposure") / 2).alias("relevance"), (F.col("risk") > 1).alias("used"))
    return rounded(lab.observation_metrics(s, "relevance", "used", ["condition"]), 9)


@Q.query(f"""
    WITH {SCORES_SQL} SELECT event_id, (risk > 1 AND exposure = 0) OR (risk <= 1 AND exposure > 0) AS mismatch FROM scores WHERE (risk > 1 AND exposure = 0) OR (risk <= 1 AND exposure > 0)
""")
def schema_mismatches(spark: SparkSession, d: str) -> DataFrame:
    bad = F.expr("(risk > 1 and exposure = 0) or (risk <= 1 and exposure > 0)")
    return scores(spark, d).select("event_id", bad.alias("mismatch")).where("mismatch")


@Q.query("""
    SELECT o_orderstatus, count(*) AS n, sum(o_totalprice > 100000)::BIGINT AS heavy, round(sum(ceil(length(o_orderpriority) / 4)) + 260.0 * count(*) FILTER (o_orderstatus = 'F') + 24 * count(*), 3) AS tokens,
           round((sum(ceil(length(o_orderpriority) / 4)) + 260.0 * count(*) FILTER (o_orderstatus = 'F') + 24 * count(*)) * 0.15 / 1000000, 9) AS price FROM orders GROUP BY 1
""")
def planned_cost(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    tokens = F.ceil(F.length("o_orderpriority") / 4) + F.when(F.col("o_orderstatus") == "F", 260.0).otherwise(0.0) + 24
    g = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("heavy"), F.sum(tokens).alias("tokens"))
    return g.withColumn("price", F.round(F.col("tokens") * 0.15 / 1_000_000, 9)).withColumn("tokens", F.round("tokens", 3))


@Q.query(f"""
    WITH {OUTCOMES_SQL} SELECT card_id, count(*) AS actions, count(*) FILTER (response > 0.5) AS wins, round(0.5 + count(*) FILTER (response < 0.5) / count(*) / 2, 6) AS against_first,
        round(0.5 + count(*) FILTER (response > 0.5) / count(*) / 2, 6) AS against_second FROM outcomes GROUP BY 1
""")
def oracle_bounds(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.policy import oracle_bound

    r = F.col("response")
    wins, losses, n = F.count_if(r > 0.5), F.count_if(r < 0.5), F.count("*")
    a, b = oracle_bound(wins, losses, n)
    return rounded(outcomes(spark, d).groupBy("card_id").agg(n.alias("actions"), wins.alias("wins"), a.alias("against_first"), b.alias("against_second")))


@Q.query(f"""
    WITH {OUTCOMES_SQL} SELECT flag, count(*) AS n, round(avg(response), 6) AS response_mean, round(median(response), 6) AS response_median, round(min(response), 6) AS response_min, round(max(response), 6) AS response_max,
        count(cost) AS cost_n, round(avg(cost), 6) AS cost_mean, round(median(cost), 6) AS cost_median, round(min(cost), 6) AS cost_min, round(max(cost), 6) AS cost_max FROM outcomes GROUP BY 1
""")
def number_summaries(spark: SparkSession, d: str) -> DataFrame:
    cols = p.number_summary(F.col("response"), "response") + p.number_summary(F.col("cost"), "cost")
    return rounded(outcomes(spark, d).groupBy("flag").agg(*cols).withColumnRenamed("response_n", "n"))
