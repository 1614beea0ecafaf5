"""Panel summaries: means, paired deltas, costs, severities, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import panel as p
from tessera.plans.views import PANEL_SQL, SCORES_SQL, VERDICTS_SQL, panel, scores, verdicts
from tessera.queries.registry import Registry
from tessera.session import table

Q = Registry()


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@Q.query(f"""
    WITH {SCORES_SQL} SELECT condition, count(*) AS n, round(avg(rating), 6) AS rating, round(avg(second), 6) AS second FROM scores GROUP BY 1
""")
def condition_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.condition_means(scores(spark, d), "condition", ["rating", "second"]))


_PAIRS = f"""{PANEL_SQL}, pairs AS (SELECT a.user_id, a.day, a.value AS value_a, b.value AS value_b, a.n AS n_a, b.n AS n_b, a.value - b.value AS delta
    FROM panel a JOIN panel b ON a.user_id = b.user_id AND a.day = b.day AND a.condition = 'purchase' AND b.condition = 'view')"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    both = p.paired(panel(spark, d), ["user_id", "day"], "condition", ["value", "n"], "purchase", "view")
    return both.withColumn("delta", F.col("value_a") - F.col("value_b"))


@Q.query(f"WITH {_PAIRS} SELECT user_id, day::VARCHAR AS day, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, n_a, n_b, round(delta, 6) AS delta FROM pairs")
def paired_conditions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs(spark, d).withColumn("day", F.col("day").cast("string")))


@Q.query(f"""
    WITH {_PAIRS} SELECT count(delta) AS n, round(avg(delta), 6) AS mean, round(median(delta), 6) AS median, round(min(delta), 6) AS min, round(max(delta), 6) AS max,
        count(*) FILTER (delta > 0) AS higher, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS lower, round(avg((delta >= 0)::INT), 6) AS tie_or_higher FROM pairs
""")
def delta_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.delta_summary(pairs(spark, d), "delta"))


@Q.query(f"""
    WITH {_PAIRS}, s AS (SELECT 'all' AS subset, delta FROM pairs UNION ALL SELECT 'busy', delta FROM pairs WHERE n_a > 1 OR n_b > 1
        UNION ALL SELECT 'even', delta FROM pairs WHERE n_a = n_b UNION ALL SELECT 'first half', delta FROM pairs WHERE day(day) <= 15)
    SELECT subset, count(delta) AS n, round(avg(delta), 6) AS mean, round(median(delta), 6) AS median, round(min(delta), 6) AS min, round(max(delta), 6) AS max,
        count(*) FILTER (delta > 0) AS higher, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS lower, round(avg((delta >= 0)::INT), 6) AS tie_or_higher
    FROM s GROUP BY 1
""")
def subset_deltas(spark: SparkSession, d: str) -> DataFrame:
    subsets = {"all": F.lit(True), "busy": F.expr("n_a > 1 or n_b > 1"), "even": F.expr("n_a = n_b"), "first half": F.expr("day(day) <= 15")}
    return rounded(p.subset_summary(pairs(spark, d), subsets, "delta"))


_COSTS = """costs AS (SELECT event_type AS condition, count(*) AS n, avg((value > 50)::INT) AS heavy_rate, avg((event_id % 2 = 0)::INT) AS even_rate,
    avg(value) AS value_mean, median(value) AS value_median, quantile_cont(value, 0.95) AS value_p95, sum(value) AS value_total,
    avg(k) AS k_mean, median(k) AS k_median, quantile_cont(k, 0.95) AS k_p95, sum(k)::BIGINT AS k_total
    FROM (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events) GROUP BY 1)"""


def costs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumnRenamed("event_type", "condition")
    return p.cost_summary(e, "condition", ["value", "k"], {"heavy_rate": F.col("value") > 50, "even_rate": F.expr("event_id % 2 = 0")})


@Q.query(f"""
    WITH {_COSTS} SELECT condition, n, round(heavy_rate, 6) AS heavy_rate, round(even_rate, 6) AS even_rate, round(value_mean, 6) AS value_mean,
    round(value_median, 6) AS value_median, round(value_p95, 6) AS value_p95, round(value_total, 4) AS value_total, round(k_mean, 6) AS k_mean,
    round(k_median, 6) AS k_median, round(k_p95, 6) AS k_p95, k_total FROM costs
""")
def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(costs(spark, d)).withColumn("value_total", F.round("value_total", 4))


@Q.query(f"""
    WITH {_COSTS}, l AS (SELECT condition, 'value_mean' AS field, value_mean AS x FROM costs UNION ALL SELECT condition, 'k_mean', k_mean FROM costs)
    SELECT b.condition AS baseline_condition, b.field, round(b.x, 6) AS baseline, round(t.x, 6) AS treatment, round(t.x - b.x, 6) AS difference,
           round(CASE WHEN b.x <> 0 THEN (b.x - t.x) / b.x END, 6) AS saving
    FROM l b JOIN l t ON b.field = t.field AND t.condition = 'purchase' AND b.condition <> 'purchase'
""")
def resource_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.resource_comparison(costs(spark, d), "condition", "purchase", ["value_mean", "k_mean"]))


@Q.query(f"""
    WITH {SCORES_SQL}, l AS (SELECT condition, 'risk' AS field, risk::DOUBLE AS x FROM scores UNION ALL SELECT condition, 'exposure', exposure FROM scores)
    SELECT condition, field, count(x) AS n, count(*) FILTER (x > 0) AS positive, count(*) FILTER (x >= 2) AS major, round(avg(x), 6) AS mean FROM l GROUP BY 1, 2
""")
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.severity_summary(scores(spark, d), ["risk", "exposure"], ["condition"]))


@Q.query(f"""
    WITH {SCORES_SQL}, s AS (SELECT unit, condition, variant, min(position) AS position, avg(rating) AS rating FROM scores GROUP BY 1, 2, 3),
    o AS (SELECT *, first(rating) OVER w AS f, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY unit, condition ORDER BY variant))
    SELECT (SELECT round(avg(abs(rating - f)), 6) FROM o WHERE k > 1) AS mean_abs_change,
           (SELECT round(max(abs(m - (SELECT avg(rating) FROM s))), 6) FROM (SELECT avg(rating) AS m FROM s GROUP BY position)) AS position_bias, 'rating' AS field
""")
def order_stability(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).groupBy("unit", "condition", "variant").agg(F.min("position").alias("position"), F.avg("rating").alias("rating"))
    return rounded(p.order_stability(s, ["unit", "condition"], "variant", "position", ["rating"]))


@Q.query("""
    SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 9) AS rate FROM events GROUP BY 1, 2
""")
def action_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.shares(table(spark, d, "events"), ["user_id"], "event_type"), 9)


@Q.query("""
    WITH n AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY 1, 2)
    SELECT user_id, round(sum(-p * log2(p)), 9) AS entropy, round(max(p), 9) AS top_share FROM n GROUP BY 1
""")
def action_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.entropy_bits(table(spark, d, "events"), "event_type", ["user_id"]), 9)


@Q.query(f"""
    WITH {VERDICTS_SQL} SELECT "order", count(*) FILTER (label = 'A') AS wins, count(*) FILTER (label = 'tie') AS ties, count(*) FILTER (label = 'B') AS losses,
        round((count(*) FILTER (label = 'A') + count(*) FILTER (label = 'tie') / 2) / count(*), 9) AS score FROM verdicts GROUP BY 1
""")
def win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.win_tie_loss(verdicts(spark, d), F.col("label"), ["order"]), 9)


@Q.query(f"""
    WITH {VERDICTS_SQL} SELECT day(day)::INT AS day_of_month, count(*) FILTER (label = 'B') AS wins, count(*) FILTER (label = 'tie') AS ties,
        count(*) FILTER (label = 'A') AS losses, round((count(*) FILTER (label = 'B') + count(*) FILTER (label = 'tie') / 2) / count(*), 9) AS score FROM verdicts GROUP BY 1
""")
def target_wins(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d).withColumn("day_of_month", F.day("day"))
    return rounded(p.target_wins(v, "label", "B", ["day_of_month"]), 9)


_DUAL = f"""{VERDICTS_SQL}, bo AS (SELECT user_id, day, max(CASE WHEN "order" = 'AB' THEN label END) AS forward,
    max(CASE WHEN "order" = 'BA' THEN CASE label WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE label END END) AS backward FROM verdicts GROUP BY 1, 2)"""


@Q.query(f"WITH {_DUAL} SELECT user_id, day::VARCHAR AS day, forward, backward, CASE WHEN forward = backward THEN forward ELSE 'tie' END AS winner, forward = backward AS consistent FROM bo")
def dual_order_strict(spark: SparkSession, d: str) -> DataFrame:
    return p.dual_order(verdicts(spark, d).withColumn("day", F.col("day").cast("string")), ["user_id", "day"], "order", "label", tie_absorbs=False)


@Q.query(f"""
    WITH {_DUAL} SELECT user_id, day::VARCHAR AS day, forward, backward, CASE WHEN forward = backward THEN forward WHEN forward = 'tie' THEN backward WHEN backward = 'tie' THEN forward ELSE 'tie' END AS winner,
        forward = backward AS consistent FROM bo
""")
def dual_order_absorbing(spark: SparkSession, d: str) -> DataFrame:
    return p.dual_order(verdicts(spark, d).withColumn("day", F.col("day").cast("string")), ["user_id", "day"], "order", "label", tie_absorbs=True)


@Q.query(f"""
    WITH {_DUAL} SELECT day(day)::INT AS day_of_month, count(*) AS pair_units, round(avg((forward = backward)::INT), 9) AS consistency,
        avg((forward = backward)::INT) >= 0.8 AS gate, round(avg(CASE WHEN forward <> backward THEN 0.5 WHEN forward = 'A' THEN 1 WHEN forward = 'tie' THEN 0.5 ELSE 0 END), 9) AS preference
    FROM bo GROUP BY 1
""")
def orientation_gate(spark: SparkSession, d: str) -> DataFrame:
    both = p.dual_order(verdicts(spark, d), ["user_id", "day"], "order", "label", tie_absorbs=False)
    score = F.when(F.col("winner") == "A", 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0)
    same = F.avg(F.col("consistent").cast("double"))
    out = both.groupBy(F.day("day").alias("day_of_month")).agg(F.count("*").alias("pair_units"), same.alias("consistency"), (same >= 0.8).alias("gate"), F.avg(score).alias("preference"))
    return rounded(out, 9)


@Q.query(f"""
    WITH {VERDICTS_SQL} SELECT "order", round(avg((label = 'tie')::INT), 9) AS tie_rate,
        round(abs(count(*) FILTER (label = 'A') - count(*) FILTER (label = 'B')) / (count(*) FILTER (label = 'A') + count(*) FILTER (label = 'B')), 9) AS position_bias
    FROM verdicts GROUP BY 1
""")
def response_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.count_if(F.col("label") == "A"), F.count_if(F.col("label") == "B")
    out = verdicts(spark, d).groupBy("order").agg(F.avg((F.col("label") == "tie").cast("double")).alias("tie_rate"), F.try_divide(F.abs(a - b), a + b).alias("position_bias"))
    return rounded(out, 9)


@Q.query("""
    SELECT user_id, count(*) AS n, round(avg(value), 6) AS score FROM events GROUP BY 1 HAVING count(*) >= 5 ORDER BY round(avg(value), 6) DESC, n DESC, user_id LIMIT 20
""")
def top_groups(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("score"))
    return p.top_groups(g, "n", "score", "user_id", 5, 20)


@Q.query("""
    WITH g AS (SELECT unnest(list_filter(['depth ' || CASE WHEN turn <= 2 THEN 'opening' ELSE 'later' END, CASE WHEN contains(text, '?') THEN 'question' END,
        CASE WHEN length(text) > 400 THEN 'long' END], lambda x: x IS NOT NULL)) AS label, length(text) AS n FROM conversations)
    SELECT label, count(*) AS turns, round(avg(n), 6) AS mean_length FROM g GROUP BY 1
""")
def overlapping_groups(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    labels = [
        F.when(F.col("turn") <= 2, "depth opening").otherwise("depth later"),
        F.when(t.contains("?"), "question"),
        F.when(F.length(t) > 400, "long"),
    ]
    rows = table(spark, d, "conversations").select(F.explode(F.array_compact(F.array(*labels))).alias("label"), F.length(t).alias("n"))
    return rounded(rows.groupBy("label").agg(F.count("*").alias("turns"), F.avg("n").alias("mean_length")))


@Q.query("""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    p AS (SELECT event_type, value AS p95_lower FROM r WHERE r = floor(0.95 * (n - 1)))
    SELECT event_type, p95_lower, round(quantile_cont(value, 0.95), 6) AS p95_linear, count(*) AS n, round(stddev_pop(value), 6) AS std FROM events JOIN p USING (event_type) GROUP BY 1, 2
""")
def percentile_rules(spark: SparkSession, d: str) -> DataFrame:
    from tessera.functions.numbers import percentile_linear, percentile_lower

    e = table(spark, d, "events")
    low = percentile_lower(e, ["event_type"], "value", 0.95, "p95_lower")
    lin = e.groupBy("event_type").agg(percentile_linear("value", 0.95).alias("p95_linear"), F.count("*").alias("n"), F.stddev_pop("value").alias("std"))
    return rounded(lin.join(low, "event_type"))


@Q.query("""
    WITH m AS (SELECT median(value) AS m FROM events), g AS (SELECT user_id, event_type, median(value) AS med FROM events GROUP BY 1, 2)
    SELECT e.user_id, e.event_type, round(any_value(g.med), 6) AS med, round(median(abs(e.value - g.med)), 6) AS mad, median(abs(e.value - g.med)) <= 20 AS reliable
    FROM events e JOIN g ON e.user_id = g.user_id AND e.event_type = g.event_type GROUP BY 1, 2
""")
def median_deviation(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.agreement import median_deviation as mad

    out = mad(table(spark, d, "events"), ["user_id", "event_type"], "value")
    return rounded(out.withColumn("reliable", F.col("mad") <= 20))


@Q.query(f"""
    WITH {SCORES_SQL} SELECT CASE WHEN condition IS NOT NULL THEN 'condition' WHEN variant IS NOT NULL THEN 'variant' ELSE 'risk' END AS dimension,
        coalesce(condition, variant::VARCHAR, risk::VARCHAR) AS value, count(*) AS n, round(avg(rating), 6) AS rating
    FROM scores GROUP BY GROUPING SETS ((condition), (variant), (risk))
""")
def audit_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    """One pass over three grouping sets instead of three scans."""
    g = scores(spark, d).groupingSets([["condition"], ["variant"], ["risk"]], "condition", "variant", "risk").agg(F.count("*").alias("n"), F.avg("rating").alias("rating"))
    dim = F.when(F.col("condition").isNotNull(), "condition").when(F.col("variant").isNotNull(), "variant").otherwise("risk")
    return rounded(g.select(dim.alias("dimension"), F.coalesce("condition", F.col("variant").cast("string"), F.col("risk").cast("string")).alias("value"), "n", "rating"))
