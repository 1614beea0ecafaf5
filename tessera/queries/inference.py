"""Intervals, tests, agreement, calibration and text metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import token_set
from tessera.operators import agreement as ag
from tessera.operators import inference as inf
from tessera.operators import textmetrics as tm
from tessera.plans.views import SCORES_SQL, VERDICTS_SQL, scores, verdicts
from tessera.queries.panel import _PAIRS, pairs, rounded
from tessera.queries.registry import Registry
from tessera.session import table

Q = Registry()

_CLUSTERS = f"{_PAIRS}, c AS (SELECT user_id AS cluster, sum(delta) AS s, count(*) AS n, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS k FROM pairs GROUP BY 1)"


def _draw(seed: str, reps: int) -> str:
    return f"d AS (SELECT rep, ('0x' || substr(md5('{seed}' || chr(31) || rep || chr(31) || i), 1, 8))::BIGINT % k AS i FROM c, range({reps}) r(rep))"


def deltas(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select(F.lit("all").alias("g"), "user_id", "delta")


@Q.query(f"WITH {_CLUSTERS} SELECT 'all' AS g, count(*) AS clusters, sum(n)::BIGINT AS rows, round(sum(s) / sum(n), 6) AS pooled, round(avg(s / n), 6) AS clustered FROM c")
def cluster_estimates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inf.cluster_estimate(deltas(spark, d), ["g"], "user_id", "delta"))


@Q.query(f"""
    WITH {_CLUSTERS}, {_draw('1729', 10000)}, v AS (SELECT rep, avg(s / n) AS value FROM d JOIN c USING (i) GROUP BY 1)
    SELECT 'all' AS g, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM v
""")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inf.interval(inf.bootstrap(deltas(spark, d), ["g"], "user_id", "delta"), ["g"]))


@Q.query(f"""
    WITH {_CLUSTERS}, {_draw('1729', 10000)}, v AS (SELECT rep, sum(s) / sum(n) AS value FROM d JOIN c USING (i) GROUP BY 1),
    r AS (SELECT value, row_number() OVER (ORDER BY value, rep) - 1 AS r, count(*) OVER () AS n FROM v)
    SELECT 'all' AS g, round(max(CASE WHEN r = floor(n * 0.025::DOUBLE) THEN value END), 6) AS low, round(max(CASE WHEN r = floor(n * 0.975::DOUBLE) THEN value END), 6) AS high FROM r
""")
def pooled_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    reps = inf.bootstrap(deltas(spark, d), ["g"], "user_id", "delta", pooled=True)
    return rounded(inf.interval(reps, ["g"], by_rank=True))


@Q.query(f"""
    WITH {_CLUSTERS}, f AS (SELECT rep, avg(CASE WHEN ('0x' || substr(md5('7' || chr(31) || rep || chr(31) || i), 1, 8))::BIGINT % 2 = 0 THEN s / n ELSE -s / n END) AS f, avg(s / n) AS t, any_value(k) AS k FROM c, range(10000) r(rep) GROUP BY 1)
    SELECT 'all' AS g, any_value(k) AS clusters, round(any_value(t), 6) AS mean, round((count(*) FILTER (abs(f) >= abs(t) - 1e-12) + 1) / 10001, 9) AS p_value FROM f
""")
def sign_flip_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inf.sign_flip_test(deltas(spark, d), ["g"], "user_id", "delta"), 9).withColumn("mean", F.round("mean", 6))


@Q.query(f"""
    WITH {_PAIRS}, vals AS (SELECT user_id AS o, day(day) % 4 AS u, delta AS x, row_number() OVER (PARTITION BY user_id, day(day) % 4 ORDER BY delta) - 1 AS v FROM pairs),
    j AS (SELECT o, u, count(*) AS kv, row_number() OVER (PARTITION BY o ORDER BY u) - 1 AS j, count(*) OVER (PARTITION BY o) AS kj FROM vals GROUP BY 1, 2),
    os AS (SELECT o, kj, row_number() OVER (ORDER BY o) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT o, kj FROM j)),
    a AS (SELECT rep, os.i AS slot, ('0x' || substr(md5('1729' || chr(31) || rep || chr(31) || os.i), 1, 8))::BIGINT % k AS i FROM os, range(10000) r(rep)),
    b AS (SELECT rep, slot, o, kj, t, ('0x' || substr(md5('1730' || chr(31) || rep || chr(31) || slot || chr(31) || t), 1, 8))::BIGINT % kj AS j FROM a JOIN os USING (i), range(4) x(t) WHERE t < kj),
    c AS (SELECT rep, slot, t, o, u, ('0x' || substr(md5('1731' || chr(31) || rep || chr(31) || slot || chr(31) || t || chr(31) || z), 1, 8))::BIGINT % kv AS v
          FROM (SELECT rep, slot, t, o, u, kv, unnest(range(kv)) AS z FROM b JOIN j USING (o, j))),
    m AS (SELECT rep, slot, avg(m) AS m FROM (SELECT rep, slot, t, avg(x) AS m FROM c JOIN vals USING (o, u, v) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    v AS (SELECT rep, avg(m) AS value FROM m GROUP BY 1)
    SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(avg(value), 6) AS mean FROM v
""")
def hierarchical_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).select("user_id", (F.day("day") % 4).alias("scenario"), "delta")
    v = inf.hierarchical_bootstrap(p, "user_id", "scenario", "delta")
    return rounded(v.agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"), F.avg("value").alias("mean")))


@Q.query(f"""
    WITH {VERDICTS_SQL}, p AS (SELECT user_id, CASE label WHEN 'A' THEN 0.5 WHEN 'B' THEN -0.5 ELSE 0 END::DOUBLE AS delta FROM verdicts WHERE "order" = 'AB'),
    c AS (SELECT user_id AS cluster, sum(delta) AS s, count(*) AS n, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS k FROM p GROUP BY 1), {_draw('1729', 10000)},
    v AS (SELECT rep, avg(s / n) AS value FROM d JOIN c USING (i) GROUP BY 1), q AS (SELECT quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM v)
    SELECT 'all' AS g, round(low, 6) AS low, round(high, 6) AS high, low > 0 AS superior, low > -0.05 AS non_inferior, low >= -0.05 AS at_margin, high < 0 AS inferior FROM q
""")
def preference_interval(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d).where("order = 'AB'").select(F.lit("all").alias("g"), "user_id", inf.preference_value(F.col("label")).alias("delta"))
    i = inf.interval(inf.bootstrap(v, ["g"], "user_id", "delta"), ["g"])
    return rounded(i.select("*", *[c.alias(n) for n, c in inf.success_modes(F.col("low"), F.col("high"), 0.05).items()]))


@Q.query("""
    WITH p AS (SELECT user_id, ts::DATE AS day, event_type, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3),
    m AS (SELECT a.user_id, a.event_type, 'value' AS metric, a.value - b.value AS delta FROM p a JOIN p b ON a.user_id = b.user_id AND a.day = b.day AND b.event_type = 'view' AND a.event_type <> 'view'
          UNION ALL SELECT a.user_id, a.event_type, 'n', a.n - b.n FROM p a JOIN p b ON a.user_id = b.user_id AND a.day = b.day AND b.event_type = 'view' AND a.event_type <> 'view')
    SELECT event_type, metric, count(*) AS n, round(avg(delta), 6) AS mean, round(avg((delta < 0)::INT), 6) AS lower_rate, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses FROM m GROUP BY 1, 2
""")
def paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    """All conditions against one baseline: a window brings the unit's baseline to each row, so that nothing is joined."""
    from pyspark.sql import Window as W

    from tessera.plans.views import panel

    w = W.partitionBy("user_id", "day")
    p = panel(spark, d)
    base = lambda c: F.max(F.when(F.col("condition") == "view", F.col(c))).over(w)
    p = p.withColumn("bv", base("value")).withColumn("bn", base("n")).where("condition <> 'view' and bv is not null")
    m = F.array(F.struct(F.lit("value").alias("metric"), (F.col("value") - F.col("bv")).alias("delta")), F.struct(F.lit("n").alias("metric"), (F.col("n") - F.col("bn")).cast("double").alias("delta")))
    x = p.select(F.col("condition").alias("event_type"), F.explode(m).alias("m")).select("event_type", "m.*")
    delta = F.col("delta")
    g = x.groupBy("event_type", "metric").agg(
        F.count("*").alias("n"), F.avg(delta).alias("mean"), F.avg((delta < 0).cast("double")).alias("lower_rate"), F.count_if(delta > 0).alias("wins"), F.count_if(delta == 0).alias("ties"), F.count_if(delta < 0).alias("losses")
    )
    return rounded(g)


_VOTES = f"{SCORES_SQL}, v AS (SELECT unit, CASE WHEN rating < 3 THEN 'A' WHEN rating = 3 THEN 'tie' ELSE 'B' END AS label FROM scores)"


def votes(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("rating")
    return scores(spark, d).select("unit", F.when(r < 3, "A").when(r == 3, "tie").otherwise("B").alias("label"))


@Q.query(f"""
    WITH {_VOTES}, n AS (SELECT unit, label, count(*) AS n FROM v GROUP BY 1, 2), p AS (SELECT unit, sum(n) AS r, (sum(n * n) - sum(n)) / (sum(n) * (sum(n) - 1)) AS p FROM n GROUP BY 1),
    e AS (SELECT sum(t * t) / (sum(t) * sum(t)) AS pe FROM (SELECT sum(n) AS t FROM n GROUP BY label))
    SELECT count(*) AS items, max(r)::BIGINT AS raters, CASE WHEN min(r) = max(r) AND min(r) >= 2 AND count(*) >= 2 THEN round((avg(p) - any_value(pe)) / (1 - any_value(pe)), 6) END AS kappa FROM p, e
""")
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.fleiss_kappa(votes(spark, d), "unit", "label"))


@Q.query(f"""
    WITH {_VOTES}, n AS (SELECT unit, label, count(*) AS n FROM v GROUP BY 1, 2), m AS (SELECT unit, max(n) AS m, sum(n)::BIGINT AS votes FROM n GROUP BY 1),
    t AS (SELECT unit, any_value(votes) AS votes, CASE WHEN count(*) > 1 THEN 'tie' ELSE max(label) END AS majority FROM m JOIN n USING (unit) WHERE n = m GROUP BY 1)
    SELECT unit, votes, majority, CASE WHEN unit % 2 = 1 AND majority = 'A' THEN 'B' WHEN unit % 2 = 1 AND majority = 'B' THEN 'A' ELSE majority END AS winner FROM t
""")
def annotations(spark: SparkSession, d: str) -> DataFrame:
    m = ag.majority(votes(spark, d), "unit", "label")
    return m.withColumn("winner", ag.unblind(F.col("majority"), F.col("unit") % 2 == 1))


@Q.query(f"""
    WITH {SCORES_SQL} SELECT condition, count(*) AS n, round(avg(abs(rating - second)), 6) AS mae, round(avg((abs(rating - second) <= 1)::INT), 6) AS within_one, round(avg((rating = second)::INT), 6) AS exact,
        round(1 - avg((rating - second) * (rating - second)) / (avg(rating * rating) + avg(second * second) - 2 * avg(rating) * avg(second)), 6) AS kappa FROM scores GROUP BY 1
""")
def judge_calibration(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    return rounded(ag.calibration(s, "rating", "second", ["condition"]).join(ag.weighted_kappa(s, "rating", "second", ["condition"]).drop("n"), "condition"))


@Q.query("""
    WITH r AS (SELECT event_type, value, k, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2 AS ry
               FROM (SELECT event_type, value, (props::JSON->>'k')::BIGINT AS k FROM events))
    SELECT event_type, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1
""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rounded(ag.spearman(e, "value", "k", ["event_type"]))


_DIMS = ["risk", "exposure", "rating", "second"]


@Q.query(f"""
    WITH {SCORES_SQL}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS dimension, {c}::DOUBLE AS x FROM scores" for c in _DIMS)})
    SELECT dimension, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(avg((x <> 0)::INT), 6) AS nonzero, count(DISTINCT x) AS distinct_values, stddev_pop(x) < 1e-9 AS constant FROM l GROUP BY 1
""")
def dimension_health(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.dimension_health(scores(spark, d), _DIMS))


@Q.query(f"""
    WITH {SCORES_SQL} {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(avg(({a} = {b})::INT), 6) AS equal_rate, round(corr({a}, {b}), 6) AS corr, avg(({a} = {b})::INT) >= 0.98 AS duplicate FROM scores" for i, a in enumerate(_DIMS) for b in _DIMS[i + 1:])}
""")
def duplicate_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.duplicate_dimensions(scores(spark, d), _DIMS))


_TURN_PAIRS = """t AS (SELECT conv_id, turn, text AS hyp, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
    p AS (SELECT conv_id * 100 + turn AS id, regexp_extract_all(lower(hyp), '[A-Za-z0-9'']+') AS h, regexp_extract_all(lower(ref), '[A-Za-z0-9'']+') AS r FROM t WHERE ref IS NOT NULL)"""


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    ref = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").withColumn("ref", ref).where("ref is not null")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("hyp"), "ref")


@Q.query(f"""
    WITH {_TURN_PAIRS}, g AS (SELECT id, 1 AS n, 'h' AS s, unnest(h) AS g FROM p UNION ALL SELECT id, 1, 'r', unnest(r) FROM p
      UNION ALL SELECT id, 2, 'h', h[i] || ' ' || h[i + 1] FROM (SELECT id, h, unnest(range(1, len(h))) AS i FROM p) UNION ALL SELECT id, 2, 'r', r[i] || ' ' || r[i + 1] FROM (SELECT id, r, unnest(range(1, len(r))) AS i FROM p)),
    c AS (SELECT id, n, g, count(*) FILTER (s = 'h') AS h, count(*) FILTER (s = 'r') AS r FROM g GROUP BY 1, 2, 3),
    m AS (SELECT id, sum(least(h, r)) FILTER (n = 1) AS m1, sum(h) FILTER (n = 1) AS t1, coalesce(sum(least(h, r)) FILTER (n = 2), 0) AS m2, coalesce(sum(h) FILTER (n = 2), 0) AS t2 FROM c GROUP BY 1)
    SELECT p.id, round(CASE WHEN len(h) = 0 OR coalesce(m1, 0) = 0 THEN 0 ELSE CASE WHEN len(h) > len(r) THEN 1 ELSE exp(1 - len(r) / len(h)) END * exp((ln(m1 / t1) + ln((m2 + 1) / (t2 + 1))) / 2) END, 6) AS bleu FROM p LEFT JOIN m ON m.id = p.id
""")
def bleu(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tm.bleu(turn_pairs(spark, d), "id", "hyp", "ref"))


@Q.query(f"""
    WITH RECURSIVE {_TURN_PAIRS}, w AS (SELECT id, unnest(range(1, len(r) + 1)) AS j, unnest(r) AS b FROM p),
    lcs AS (SELECT id, 0 AS i, j, b, 0 AS v FROM w UNION ALL SELECT id, i, j, b, max(c) OVER (PARTITION BY id ORDER BY j)
          FROM (SELECT lcs.id, lcs.i + 1 AS i, lcs.j, lcs.b, greatest(lcs.v, CASE WHEN p.h[lcs.i + 1] = lcs.b THEN 1 + coalesce(lag(lcs.v) OVER (PARTITION BY lcs.id ORDER BY lcs.j), 0) ELSE 0 END) AS c FROM lcs JOIN p ON p.id = lcs.id AND lcs.i < len(p.h))),
    n AS (SELECT lcs.id, max(v) AS n FROM lcs JOIN p ON p.id = lcs.id AND lcs.i = len(p.h) GROUP BY 1)
    SELECT p.id, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE 2 * n / (len(h) + len(r)) END, 6) AS rouge_l FROM p LEFT JOIN n ON n.id = p.id
""")
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    """A longest common subsequence per row, by rows of bits in Arrow batches; the SQL fills the quadratic table row by row."""
    return rounded(tm.rouge_l(turn_pairs(spark, d), "id", "hyp", "ref"))


@Q.query("""
    WITH r AS (SELECT conv_id AS g, role AS a, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9'']+')) AS s, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations),
    p AS (SELECT true AS w, x.s AS s, y.s AS t FROM r x, r y WHERE x.g = y.g AND x.a = y.a AND x.turn < y.turn
          UNION ALL SELECT false, x.s, y.s FROM r x, r y WHERE x.g = y.g AND x.a < y.a AND x.i = y.i),
    d AS (SELECT w, CASE WHEN len(s) + len(t) = 0 THEN 0 ELSE 1 - len(list_intersect(s, t)) / (len(s) + len(t) - len(list_intersect(s, t))) END AS d FROM p),
    m AS (SELECT count(*) FILTER (w) AS n_within, avg(d) FILTER (w) AS wd, count(*) FILTER (NOT w) AS n_between, avg(d) FILTER (NOT w) AS bd FROM d)
    SELECT n_within, round(wd, 6) AS within_distance, n_between, round(bd, 6) AS between_distance, round(bd / nullif(wd, 0), 6) AS ratio, coalesce(bd / nullif(wd, 0) > 1.1::DOUBLE, false) AS passed FROM m
""")
def variance_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a dialogue stand for the responses of a card, their roles for its actions."""
    return rounded(inf.within_between(table(spark, d, "conversations"), "conv_id", "role", "turn", token_set(F.col("text"))))


@Q.query("""
    WITH c AS (SELECT event_type AS name, avg(value) > 48 AS ok FROM events GROUP BY 1 UNION ALL SELECT 'has_diag_rows', false)
    SELECT bool_and(ok) FILTER (NOT contains(name, '_diag_')) AS passed, count(*) FILTER (NOT contains(name, '_diag_')) AS checks,
           coalesce(list(name ORDER BY name) FILTER (NOT ok AND NOT contains(name, '_diag_')), []) AS failed FROM c
""")
def readiness_gate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg((F.avg("value") > 48).alias("ok"))
    diag = e.limit(1).select(F.lit("has_diag_rows").alias("name"), F.lit(False).alias("ok"))
    return inf.gate(e.unionByName(diag), "name", "ok")
