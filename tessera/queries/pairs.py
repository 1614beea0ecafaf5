"""Pair graphs, their audits, components, and scores from pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import labels as lab
from tessera.operators import pairgraph as pg
from tessera.operators.graph import connected_components
from tessera.plans.views import OUTCOMES_SQL, outcomes
from tessera.queries.facts import ACTIONS_SQL
from tessera.queries.newton import solved
from tessera.queries.panel import rounded
from tessera.queries.registry import Registry
from tessera.session import table

Q = Registry()

_CARDS = "cards AS (SELECT o_orderkey AS card_id, (o_orderkey % 8)::INT AS available FROM orders)"
_EDGES = """edges AS (SELECT a.action_id AS action_a, b.action_id AS action_b, a.mask | b.mask AS needs,
      CASE WHEN a.mask = b.mask THEN 'strategy' WHEN bit_count(xor(a.mask, b.mask)) = 1 AND least(a.n_sources, b.n_sources) = 0 THEN 'memory'
           WHEN bit_count(xor(a.mask, b.mask)) = 1 THEN 'combination' ELSE 'chord' END AS pair_type
    FROM actions a JOIN actions b ON a.action_id < b.action_id AND ((a.mask = b.mask AND a.strategy <> b.strategy) OR (a.strategy = b.strategy AND
      (bit_count(xor(a.mask, b.mask)) = 1 OR (bit_count(xor(a.mask, b.mask)) = 2 AND a.n_sources = b.n_sources)))))"""
_CARD_EDGES = f"{ACTIONS_SQL}, {_CARDS}, {_EDGES}, ce AS (SELECT card_id, available, action_a, action_b, pair_type FROM cards JOIN edges ON needs & available = needs)"


def cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("card_id"), F.pmod("o_orderkey", F.lit(8)).cast("int").alias("available"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return pg.card_edges(cards(spark, d), "card_id", "available")


@Q.query(f"WITH {ACTIONS_SQL}, {_EDGES} SELECT action_a, action_b, pair_type, needs FROM edges")
def action_edges(spark: SparkSession, d: str) -> DataFrame:
    return pg.action_edges(cards(spark, d))


@Q.query(f"WITH {_CARD_EDGES} SELECT available, pair_type, count(*) AS n FROM ce GROUP BY 1, 2")
def card_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("available", "pair_type").agg(F.count("*").alias("n"))


_PAIRS = f"""{_CARD_EDGES}, ids AS (SELECT *, 'pair_' || substr(sha256('7' || chr(31) || card_id || chr(31) || action_a || chr(31) || action_b), 1, 16) AS pair_id FROM ce),
    o AS (SELECT *, (row_number() OVER (PARTITION BY card_id, pair_type ORDER BY pair_id) - 1) % 2 = 1 AS swap FROM ids),
    base AS (SELECT card_id, pair_id, pair_type, CASE WHEN swap THEN action_b ELSE action_a END AS first, CASE WHEN swap THEN action_a ELSE action_b END AS second FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY substr(sha256('audit' || chr(31) || pair_id), 1, 16), pair_id) AS r, count(*) OVER (PARTITION BY card_id) AS n FROM base)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Cards are dealt before their edges are made, so that what is shuffled is cards, and a card's pairs lie together."""
    e = pg.card_edges(cards(spark, d).repartition("card_id"), "card_id", "available")
    return pg.oriented_pairs(e, "card_id", F.lit(7))


@Q.query(f"""
    WITH {_PAIRS} SELECT card_id, pair_id, pair_type, first, second, 'base' AS role, true AS training_eligible FROM base
    UNION ALL SELECT card_id, pair_id, pair_type, second, first, 'reversal', false FROM r WHERE r <= round_even(n * 0.15::DOUBLE, 0)
    UNION ALL SELECT card_id, pair_id, pair_type, first, second, 'repeat', false FROM r WHERE r > round_even(n * 0.15::DOUBLE, 0) AND r <= round_even(n * 0.15::DOUBLE, 0) + round_even(n * 0.10::DOUBLE, 0)
""")
def pair_graph(spark: SparkSession, d: str) -> DataFrame:
    return pg.with_audit(pairs(spark, d), "card_id")


@Q.query(f"""
    WITH {_CARD_EDGES}, v AS (SELECT card_id, action_id FROM cards JOIN actions ON mask & available = mask), e AS (SELECT card_id, action_a AS a FROM ce UNION ALL SELECT card_id, action_b FROM ce),
    g AS (SELECT card_id, a, count(*) AS deg FROM e GROUP BY 1, 2)
    SELECT card_id, count(*) AS nodes, (sum(coalesce(deg, 0)) / 2)::BIGINT AS edges, count(*) FILTER (deg IS NULL) AS isolated, min(coalesce(deg, 0)) AS least_degree, max(coalesce(deg, 0)) AS most_degree, 1::BIGINT AS components
    FROM v LEFT JOIN g USING (card_id) WHERE v.action_id = g.a OR g.a IS NULL GROUP BY 1
""")
def graph_audit(spark: SparkSession, d: str) -> DataFrame:
    return pg.graph_audit(cards(spark, d), edges(spark, d), "card_id", "available")


@Q.query("""
    WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey + 7 AS b FROM orders WHERE o_orderpriority = '1-URGENT'),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
    SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY 1
""")
def components(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 7).alias("dst"))
    return connected_components(e)


@Q.query(f"""
    WITH {OUTCOMES_SQL}, {_PAIRS} SELECT b.card_id, b.pair_id, round(x.response, 6) AS value_a, round(y.response, 6) AS value_b
    FROM base b JOIN outcomes x ON x.card_id = b.card_id AND x.action_id = b.first JOIN outcomes y ON y.card_id = b.card_id AND y.action_id = b.second
""")
def pair_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lab.pair_outcomes(pairs(spark, d), outcomes(spark, d), "card_id", "first", "second", "response"))


_WON = "list_sum(list_transform(list_filter(range(1, 17), lambda k: has[k]), lambda k: 1 / (1 + exp(m[k][17] - m[i][17]))))"
_MATRIX = """list_transform(range(1, 17), lambda i: list_transform(range(1, 18), lambda j: CASE WHEN j = 17 THEN list_sum(list_transform(l, lambda q: CASE WHEN q.a = i THEN q.y WHEN q.b = i THEN -q.y ELSE 0 END))
    WHEN i = j THEN 0.1::DOUBLE + list_sum(list_transform(l, lambda q: (q.a = i OR q.b = i)::INT::DOUBLE)) ELSE -list_sum(list_transform(l, lambda q: (q.a = i AND q.b = j OR q.a = j AND q.b = i)::INT::DOUBLE)) END))"""


@Q.query(f"""
    WITH {OUTCOMES_SQL}, {_PAIRS}, ix AS (SELECT action_id, row_number() OVER (ORDER BY action_id) AS i FROM actions),
    j AS (SELECT b.card_id, u.i AS a, v.i AS b, sign(x.response - y.response)::DOUBLE AS y FROM base b JOIN outcomes x ON x.card_id = b.card_id AND x.action_id = b.first
          JOIN outcomes y ON y.card_id = b.card_id AND y.action_id = b.second JOIN ix u ON u.action_id = b.first JOIN ix v ON v.action_id = b.second),
    g AS (SELECT card_id, list({{'a': a, 'b': b, 'y': y}}) AS l FROM j GROUP BY 1),
    s AS (SELECT card_id, has, m FROM {solved(f"(SELECT card_id, list_transform(range(1, 17), lambda i: list_bool_or(list_transform(l, lambda q: q.a = i OR q.b = i))) AS has, {_MATRIX} AS m FROM g)", 16, "card_id, has")})
    SELECT card_id, action_id, round(({_WON} - 0.5) / (list_sum(list_transform(has, lambda q: q::INT)) - 1), 6) AS score FROM s, ix WHERE has[i]
""")
def response_scores(spark: SparkSession, d: str) -> DataFrame:
    """A linear system per card."""
    p = lab.pair_outcomes(pairs(spark, d), outcomes(spark, d), "card_id", "first", "second", "response", "first", "second")
    w = F.when(F.col("value_a") > F.col("value_b"), "A").when(F.col("value_a") < F.col("value_b"), "B").otherwise("tie")
    return rounded(lab.response_scores(p.withColumn("winner", w), "card_id", "first", "second", "winner"))


@Q.query(f"""
    WITH {OUTCOMES_SQL}, {_PAIRS}, m AS (SELECT b.card_id, b.pair_id, x.response AS a, y.response AS b FROM base b JOIN outcomes x ON x.card_id = b.card_id AND x.action_id = b.first JOIN outcomes y ON y.card_id = b.card_id AND y.action_id = b.second WHERE x.response <> y.response)
    SELECT card_id, pair_id, round(sign * (a - b), 6) AS diff, CASE WHEN sign * (a - b) > 0 THEN 1 ELSE 0 END AS label, round(1 / (2 * count(*) OVER (PARTITION BY card_id) / 2), 9) AS weight FROM m, (SELECT unnest([1, -1]) AS sign)
""")
def pair_training(spark: SparkSession, d: str) -> DataFrame:
    """Differences of decided pairs and their mirror images; a card's weights sum to 1."""
    from tessera.operators.features import mirrored_pairs

    met = lab.pair_outcomes(pairs(spark, d), outcomes(spark, d), "card_id", "first", "second", "response")
    return mirrored_pairs(met, "card_id", "value_a", "value_b").select("card_id", "pair_id", F.round("diff", 6).alias("diff"), "label", F.round("weight", 9).alias("weight"))
