"""Choices of actions, their grids and metrics, features, bands and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features as ft
from tessera.operators import models
from tessera.operators import policy as po
from tessera.plans.views import OUTCOMES_SQL, outcomes
from tessera.queries.facts import ACTIONS_SQL
from tessera.queries.newton import newton, product
from tessera.queries.pairs import _EDGES as EDGES_SQL
from tessera.queries.panel import rounded
from tessera.queries.registry import Registry
from tessera.session import table

Q = Registry()
_COLS = "card_id, action_id, round(response, 6) AS response, round(misuse, 6) AS misuse, omission, cost"
COLS = ["card_id", "action_id", "response", "misuse", "omission", "cost"]


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes whose shares are rounded, so that ties are ties in any engine."""
    return outcomes(spark, d).select("card_id", "action_id", F.round("response", 6).alias("response"), F.round("misuse", 6).alias("misuse"), "omission", "cost")


_F = f"{OUTCOMES_SQL}, f AS (SELECT {_COLS} FROM outcomes)"


@Q.query(f"WITH {_F} SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY cost, misuse, omission, response DESC, action_id) = 1")
def cheapest_action(spark: SparkSession, d: str) -> DataFrame:
    return po.cheapest_action(facts(spark, d), ["card_id"])


@Q.query(f"""
    WITH {_F}, a AS (SELECT * FROM f QUALIFY response >= max(response) OVER (PARTITION BY card_id) - 0.02::DOUBLE), b AS (SELECT * FROM a QUALIFY misuse <= min(misuse) OVER (PARTITION BY card_id) + 0.02::DOUBLE)
    SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY cost, response DESC, misuse, action_id) = 1
""")
def near_best_then_cheap(spark: SparkSession, d: str) -> DataFrame:
    return po.near_best_then_cheap(facts(spark, d), ["card_id"])


@Q.query(f"WITH {_F} SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY greatest(misuse, omission), response DESC, cost, misuse, action_id) = 1")
def safety_first(spark: SparkSession, d: str) -> DataFrame:
    return po.safety_first(facts(spark, d), ["card_id"])


@Q.query(f"""
    WITH {_F}, b AS (SELECT o_orderkey AS card_id, (o_totalprice / 10000) AS budget FROM orders)
    SELECT f.*, budget FROM f JOIN b USING (card_id) QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY (cost > budget)::INT, CASE WHEN cost > budget THEN cost ELSE -response END, cost, action_id) = 1
""")
def budget_matched(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("card_id"), (F.col("o_totalprice") / 10000).alias("budget"))
    return po.budget_matched(facts(spark, d), b, "card_id", "budget")


@Q.query(f"""
    WITH {_F}, b AS (SELECT o_orderkey AS card_id, floor(o_totalprice / 10000) AS budget FROM orders)
    SELECT f.*, budget FROM f JOIN b USING (card_id) QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY abs(cost - budget), response DESC, action_id) = 1
""")
def cost_matched(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("card_id"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("budget"))
    return po.cost_matched(facts(spark, d), b, "card_id", "budget")


_CHOICE = """s AS (SELECT *, greatest(greatest(0, misuse - tm) / greatest(tm, 1e-6), greatest(0, omission - tom) / greatest(tom, 1e-6)) AS worst, greatest(0, misuse - tm) / greatest(tm, 1e-6) + greatest(0, omission - tom) / greatest(tom, 1e-6) AS total FROM g),
    t AS (SELECT *, worst = 0 AS safe, bool_or(worst = 0) OVER w AS any_safe, max(CASE WHEN worst = 0 THEN response END) OVER w AS best FROM s WINDOW w AS (PARTITION BY card_id, tm, tom, eps)),
    u AS (SELECT *, NOT any_safe AS fallback FROM t WHERE CASE WHEN any_safe THEN safe AND response >= best - eps ELSE true END),
    c AS (SELECT card_id, action_id, response, misuse, omission, cost, tm, tom, eps, fallback FROM u QUALIFY row_number() OVER (PARTITION BY card_id, tm, tom, eps ORDER BY CASE WHEN fallback THEN round(worst, 9) ELSE 0 END,
          CASE WHEN fallback THEN round(total, 9) ELSE 0 END, cost, misuse, omission, response DESC, action_id) = 1)"""


@Q.query(f"WITH {_F}, g AS (SELECT *, 0.3::DOUBLE AS tm, 0.5::DOUBLE AS tom, 0.05::DOUBLE AS eps FROM f), {_CHOICE} SELECT card_id, action_id, response, misuse, omission, cost, fallback FROM c")
def threshold_policy(spark: SparkSession, d: str) -> DataFrame:
    return po.threshold_choice(facts(spark, d), ["card_id"], F.lit(0.3), F.lit(0.5), F.lit(0.05))


_GRID = "g AS (SELECT f.*, tm, tom, eps FROM f, (SELECT unnest([0.1, 0.3, 0.6])::DOUBLE AS tm), (SELECT unnest([0.25, 0.5])::DOUBLE AS tom), (SELECT unnest([0.0, 0.05])::DOUBLE AS eps))"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    g = po.grid_metrics(facts(spark, d), "card_id", {"misuse": [0.1, 0.3, 0.6], "omission": [0.25, 0.5]}, [0.0, 0.05], entropy=True)
    return g.withColumnsRenamed({"max_misuse": "tm", "max_omission": "tom", "epsilon": "eps"})


_METRICS = """SELECT tm, tom, eps, count(*) AS states, round(avg(response), 6) AS response, round(avg(misuse), 6) AS misuse, round(avg(omission), 6) AS omission, round(avg(cost), 6) AS cost,
    round(avg(fallback::INT), 6) AS fallback_rate FROM c GROUP BY 1, 2, 3"""


@Q.query(f"""
    WITH {_F}, {_GRID}, {_CHOICE}, m AS ({_METRICS}), h AS (SELECT tm, tom, eps, action_id, count(*) AS n FROM c GROUP BY 1, 2, 3, 4),
    e AS (SELECT tm, tom, eps, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM h GROUP BY 1, 2, 3) SELECT m.*, round(entropy, 6) AS entropy FROM m JOIN e USING (tm, tom, eps)
""")
def policy_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_grid(spark, d))


@Q.query(f"""
    WITH {_F}, l AS (SELECT unnest([0.25, 0.35, 0.5, 0.75, 1.0])::DOUBLE AS t),
    g AS (SELECT card_id, action_id, response, misuse, omission, strategy, cost, a.t AS tm, b.t AS tom, c.t AS ts, e AS eps,
                 greatest(0, misuse - a.t) / a.t AS x, greatest(0, omission - b.t) / b.t AS y, greatest(0, strategy - c.t) / c.t AS z
          FROM (SELECT *, round(misuse * omission, 6) AS strategy FROM f), l a, l b, l c, (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.3])::DOUBLE AS e)),
    s AS (SELECT *, greatest(x, y, z) AS worst, bool_or(greatest(x, y, z) = 0) OVER w AS anysafe, max(CASE WHEN greatest(x, y, z) = 0 THEN response END) OVER w AS best FROM g WINDOW w AS (PARTITION BY card_id, tm, tom, ts, eps)),
    k AS (SELECT tm, tom, ts, eps, card_id, anysafe, arg_min({{'r': response, 'm': misuse, 'o': omission, 's': strategy, 'c': cost}},
                 {{'a': CASE WHEN anysafe THEN 0 ELSE round(worst, 9) END, 'b': CASE WHEN anysafe THEN 0 ELSE round(x + y + z, 9) END, 'c': cost, 'd': misuse, 'e': omission, 'f': strategy, 'g': -response, 'h': action_id}}) AS v
          FROM s WHERE NOT anysafe OR worst = 0 AND response >= best - eps GROUP BY ALL)
    SELECT tm AS max_misuse, tom AS max_omission, ts AS max_strategy, eps AS epsilon, count(*) AS states, round(avg(v.r), 6) AS response, round(avg(v.c), 6) AS cost, round(avg(v.m), 6) AS misuse, round(avg(v.o), 6) AS omission,
           round(avg(v.s), 6) AS strategy, round(avg((NOT anysafe)::INT), 6) AS fallback_rate FROM k GROUP BY 1, 2, 3, 4
""")
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    """All 750 settings of three limits and a margin."""
    f = facts(spark, d).withColumn("strategy", F.round(F.col("misuse") * F.col("omission"), 6))
    t = [0.25, 0.35, 0.5, 0.75, 1.0]
    return rounded(po.grid_metrics(f, "card_id", {"misuse": t, "omission": t, "strategy": t}, [0.0, 0.05, 0.1, 0.15, 0.2, 0.3]))


@Q.query(f"""
    WITH {_F}, {_GRID}, {_CHOICE}, m AS ({_METRICS}) SELECT tm, tom, eps, round(response - 0.5 * greatest(misuse, omission) - cost / 500, 6) AS objective FROM m WHERE fallback_rate < 0.9 ORDER BY objective DESC, tm, tom, eps LIMIT 5
""")
def tuned_policy(spark: SparkSession, d: str) -> DataFrame:
    """The five best settings by objective, of those that seldom fall back."""
    objective = F.round(F.round("response", 6) - 0.5 * F.greatest(F.round("misuse", 6), F.round("omission", 6)) - F.round("cost", 6) / 500, 6)
    g = _grid(spark, d).where("fallback_rate < 0.9").select("tm", "tom", "eps", objective.alias("objective"))
    return g.orderBy(F.col("objective").desc(), "tm", "tom", "eps").limit(5)


@Q.query(f"""
    WITH {_F}, n AS (SELECT count(DISTINCT card_id) AS cards FROM f) SELECT action_id, count(DISTINCT card_id) AS covered, CASE WHEN count(DISTINCT card_id) = any_value(cards) THEN round(avg(response), 6) END AS response,
        CASE WHEN count(DISTINCT card_id) = any_value(cards) THEN round(avg(cost), 6) END AS cost FROM f, n GROUP BY 1
""")
def fixed_actions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(po.fixed_action_metrics(facts(spark, d), "card_id"))


@Q.query(f"""
    WITH {_F}, s AS (SELECT *, cost / 500 AS std, greatest(0, response - 1.0 * (cost / 500)) AS lcb, least(1, greatest(misuse, omission) + 1.0 * (cost / 500)) AS ucb, max(CASE WHEN action_id = 'M0+R0' THEN response END) OVER (PARTITION BY card_id) AS base FROM f),
    k AS (SELECT *, ucb <= 0.7 AND lcb >= coalesce(base, 0) AND action_id <> 'M0+R0' AS ok, lcb - 0.002 * cost AS utility FROM s)
    SELECT card_id, action_id, round(lcb, 6) AS lcb, round(ucb, 6) AS ucb, round(utility, 6) AS utility, NOT ok AS fallback FROM k
    QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY ok DESC, (action_id = 'M0+R0') DESC, utility DESC, lcb DESC, ucb, cost, action_id DESC) = 1
""")
def bounded_policy(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("std", F.col("cost") / 500)
    return rounded(po.lcb_choice(f, ["card_id"], 1.0, 0.7, 0.002, "M0+R0")).select("card_id", "action_id", "lcb", "ucb", "utility", "fallback")


@Q.query(f"WITH {_F} SELECT card_id, action_id, round(1 / count(*) OVER (PARTITION BY card_id), 9) AS weight FROM f")
def regression_weights(spark: SparkSession, d: str) -> DataFrame:
    return ft.group_weights(facts(spark, d).select("card_id", "action_id"), "card_id").withColumn("weight", F.round("weight", 9))


@Q.query("""
    WITH t AS (SELECT * FROM events WHERE day(ts) <= 20), c AS (SELECT event_type, max(value) AS cap FROM t WHERE value < 90 GROUP BY 1)
    SELECT event_id, least(value, cap) AS capped, round(ln(1 + least(value, cap)), 6) AS logged FROM events JOIN c USING (event_type)
""")
def capped_features(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    out = ft.capped(e, e.where("day(ts) <= 20 and value < 90"), "event_type", "value")
    return out.select("event_id", "capped", F.round(F.log1p("capped"), 6).alias("logged"))


@Q.query("""
    WITH b AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0, max(l_extendedprice) AS p1 FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
    o AS (SELECT l_orderkey, (l_quantity < q0 - 1e-12 OR l_quantity > q1 + 1e-12)::INT AS a, (l_extendedprice < p0 - 1e-12 OR l_extendedprice > p1 + 1e-12)::INT AS b,
          greatest(q0 - l_quantity, l_quantity - q1, p0 - l_extendedprice, l_extendedprice - p1, 0) AS m FROM lineitem, b)
    SELECT l_orderkey, count(*) AS n, round(avg((a + b) / 2), 6) AS outside, round(max(m), 6) AS margin, avg((a + b) / 2) > 0.1 OR max(m) > 1 AS severe FROM o GROUP BY 1
""")
def envelope_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    train = rows.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"))
    return rounded(ft.envelope_report(rows, train, ["l_quantity", "l_extendedprice"], "l_orderkey"))


@Q.query("""
    WITH c AS (SELECT list(m ORDER BY i) AS centre FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) WHERE label < 8 GROUP BY 1)),
    s AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], centre) AS far FROM embeddings, c), t AS (SELECT greatest(0.45, 2 * quantile_cont(far, 0.95)) AS t FROM s WHERE label < 8)
    SELECT vec_id, round(far, 6) AS distance, far > t AS severe FROM s, t
""")
def centroid_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rounded(ft.centroid_report(e, e.where("label < 8"), "vec_id", "embedding"))


@Q.query("""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_]+') AS t FROM documents),
    g AS (SELECT doc_id, unnest(t) AS term FROM w UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM w)),
    tf AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df, sum(n) AS total FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 2048),
    x AS (SELECT doc_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM w)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))
    SELECT doc_id, count(*) AS terms, round(max(w / z), 6) AS top FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS z FROM x) GROUP BY 1
""")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    t = ft.tfidf(table(spark, d, "documents"), "doc_id", "text", max_terms=2048, min_df=2)
    return t.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("top"))


@Q.query("""
    WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], centre) AS s FROM embeddings JOIN c USING (label))
    SELECT label, count(*) AS n, round(avg(s), 6) AS mean_similarity, round(max(s), 6) AS max_similarity, round(quantile_cont(s, 0.9), 6) AS p90_similarity, round(avg((s < 0.1)::INT), 6) AS conflict FROM s GROUP BY 1
""")
def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ft.catalog_summary(table(spark, d, "embeddings"), "label", "embedding"))


_HELD = "('0x' || substr(md5('fold' || chr(31) || card_id), 1, 8))::BIGINT % 5 = 0"


@Q.query(f"""
    WITH RECURSIVE {_F}, {ACTIONS_SQL}, {EDGES_SQL},
    e AS (SELECT a.card_id, a.response > b.response AS win, [a.misuse - b.misuse, a.omission - b.omission, a.cost - b.cost]::DOUBLE[] AS x, 0.5::DOUBLE / count(*) OVER (PARTITION BY a.card_id) AS w
          FROM f a JOIN edges ON a.action_id = action_a JOIN f b ON b.card_id = a.card_id AND b.action_id = action_b WHERE a.response <> b.response),
    p AS (SELECT card_id, {_HELD} AS held, w, list_transform(x, lambda q: s * q) AS x, (win = (s > 0))::INT AS y FROM e, (SELECT unnest([1, -1]) AS s)),
    d AS (SELECT 1 AS k, x, y, w FROM p WHERE NOT held), {newton("fit", "d", "k", 3)},
    q AS (SELECT y, 1 / (1 + exp(-{product("v", "x", 3)})) AS q FROM p, fit WHERE held)
    SELECT count(*) AS n, round(avg(((q > 0.5) = (y = 1))::INT), 6) AS accuracy, round(avg(-ln(greatest(1e-9, least(1 - 1e-9, CASE WHEN y = 1 THEN q ELSE 1 - q END)))), 6) AS log_loss FROM q
""")
def pair_ranker(spark: SparkSession, d: str) -> DataFrame:
    """A weighted logistic model of which of two actions has the better response, along the edges of the pair graph; accuracy and log-loss on held-out cards."""
    return rounded(models.rank_metrics(facts(spark, d), "card_id", ["misuse", "omission", "cost"], "response"))


@Q.query(f"""
    WITH {_F}, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY card_id) AS w, ('0x' || substr(md5('fold' || chr(31) || card_id), 1, 8))::BIGINT % 5 = 0 AS held FROM f),
    u AS (SELECT cost::DOUBLE AS x, omission::DOUBLE AS z, w, held, unnest(['response', 'misuse', 'memory_quality', 'strategy_risk', 'strategy_quality']) AS head,
                 unnest([response, misuse, 1 - misuse, misuse * omission, response / 2 + cost / 100]::DOUBLE[]) AS y FROM w),
    s AS (SELECT head, sum(w) AS a, sum(w * x) AS b, sum(w * z) AS c, sum(w * x * x) + 5 AS d, sum(w * x * z) AS e, sum(w * z * z) + 5 AS g, sum(w * y) AS t0, sum(w * x * y) AS t1, sum(w * z * y) AS t2 FROM u WHERE NOT held GROUP BY 1),
    k AS (SELECT head, (t0 * (d * g - e * e) - b * (t1 * g - e * t2) + c * (t1 * e - d * t2)) / det AS x0, (a * (t1 * g - e * t2) - t0 * (b * g - e * c) + c * (b * t2 - t1 * c)) / det AS x1,
                 (a * (d * t2 - t1 * e) - b * (b * t2 - t1 * c) + t0 * (b * e - d * c)) / det AS x2 FROM (SELECT *, a * (d * g - e * e) - b * (b * g - e * c) + c * (b * e - d * c) AS det FROM s))
    SELECT head, count(*) AS n, round(avg(abs(greatest(0, least(1, x0 + x1 * x + x2 * z)) - y)), 6) AS mae FROM u JOIN k USING (head) WHERE held GROUP BY 1
""")
def ridge_heads(spark: SparkSession, d: str) -> DataFrame:
    """Five weighted ridge heads by normal equations; absolute error on held-out cards."""
    m, o, r = F.col("misuse"), F.col("omission"), F.col("response")
    f = facts(spark, d).withColumns({"memory_quality": 1 - m, "strategy_risk": m * o, "strategy_quality": r / 2 + F.col("cost") / 100})
    return rounded(models.ridge_metrics(f, "card_id", ["cost", "omission"], ["response", "misuse", "memory_quality", "strategy_risk", "strategy_quality"]))


@Q.query()
def bootstrap_trees(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: an ensemble over group bootstraps; mean and deviation of its members."""
    return models.bootstrap_predictions(facts(spark, d), "card_id", ["cost", "misuse"], "response")


@Q.query("""
    WITH s AS (SELECT vec_id, list_reverse_sort(list_filter([{'x': embedding[1]::DOUBLE, 'n': 'MP', 'bit': 1}, {'x': embedding[2]::DOUBLE, 'n': 'MS', 'bit': 2}, {'x': embedding[3]::DOUBLE, 'n': 'ME', 'bit': 4}], lambda r: r.x >= 0.02::DOUBLE)) AS g, embedding[4]::DOUBLE AS c FROM embeddings),
    m AS (SELECT vec_id, c, coalesce(list_sum(list_transform(g[1:2], lambda r: r.bit)), 0)::INT AS mask FROM s)
    SELECT vec_id, CASE mask WHEN 0 THEN 'M0' WHEN 1 THEN 'MP' WHEN 2 THEN 'MS' WHEN 4 THEN 'ME' WHEN 3 THEN 'MPMS' WHEN 5 THEN 'MPE' WHEN 6 THEN 'MSE' ELSE 'MPMSME' END || CASE WHEN c >= 0.05::DOUBLE THEN '+RS' ELSE '+R0' END AS action_id FROM m
""")
def strong_rule(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    rule = po.strong_rule({"MP": e[0], "MS": e[1], "ME": e[2]}, e[3].cast("double"), 0.02, 2, 0.05)
    return table(spark, d, "embeddings").select("vec_id", rule.alias("action_id"))


@Q.query("""
    WITH p AS (SELECT user_id, ts::DATE AS day, event_type, max(event_id) % 3 AS c FROM events GROUP BY 1, 2, 3)
    SELECT a.event_type, count(*) AS units, round(avg((a.c = b.c)::INT), 6) AS same_rate FROM p a JOIN p b ON a.user_id = b.user_id AND a.day = b.day AND b.event_type = 'view' AND a.event_type <> 'view' GROUP BY 1
""")
def same_choice_rate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg((F.max("event_id") % 3).alias("c"))
    return rounded(po.same_choice_rate(p, ["user_id", "day"], "event_type", "c", "view"))


@Q.query(f"""
    WITH {_F}, b AS (SELECT card_id, action_id FROM f QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY response DESC, cost, action_id DESC) = 1),
    e AS (SELECT card_id, action_id FROM f QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY cost DESC, action_id DESC) = 1)
    SELECT card_id, 'best' AS reason, action_id FROM b UNION ALL SELECT card_id, 'baseline', action_id FROM f WHERE action_id = 'M0+R0' UNION ALL SELECT card_id, 'expensive', action_id FROM e
""")
def audit_picks(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.sampling import audit_picks as picks

    return picks(facts(spark, d), "card_id", "M0+R0")


@Q.query(f"""
    WITH {_F}, a AS (SELECT card_id % 12 AS cluster, response - 0.5 AS d FROM f QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY cost, misuse, omission, response DESC, action_id) = 1),
    c AS (SELECT cluster, sum(d) AS s, count(*) AS n, row_number() OVER (ORDER BY cluster) - 1 AS i, count(*) OVER () AS k FROM a GROUP BY 1),
    w AS (SELECT rep, ('0x' || substr(md5('1729' || chr(31) || rep || chr(31) || i), 1, 8))::BIGINT % k AS i FROM c, range(10000) r(rep)), v AS (SELECT rep, avg(s / n) AS value FROM w JOIN c USING (i) GROUP BY 1)
    SELECT 'cheapest' AS policy, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM v
""")
def selection_interval(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators import inference as inf

    c = po.cheapest_action(facts(spark, d), ["card_id"]).select(F.lit("cheapest").alias("policy"), (F.col("card_id") % 12).alias("cluster"), (F.col("response") - 0.5).alias("d"))
    return rounded(inf.interval(inf.bootstrap(c, ["policy"], "cluster", "d"), ["policy"]))


@Q.query("""
    WITH t AS (SELECT conv_id, turn, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens, length(text) AS chars, contains(text, '?') AS q FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, round(ln(1 + tokens), 6) AS log_tokens, round(least(1, chars / 400), 6) AS length_share, q::INT AS question, round(least(turn, 8) / 8, 6) AS depth FROM t
""")
def dense_features(spark: SparkSession, d: str) -> DataFrame:
    """The dense block of a state's features: transforms of lengths, cues and depth, all columns."""
    from tessera.functions.text import estimate_tokens

    t = F.col("text")
    cols = {
        "log_tokens": F.log1p(estimate_tokens(t)),
        "length_share": F.least(F.lit(1.0), F.length(t) / 400),
        "question": t.contains("?").cast("int"),
        "depth": F.least(F.col("turn"), F.lit(8)) / 8,
    }
    return rounded(table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", *[c.alias(n) for n, c in cols.items()]))
