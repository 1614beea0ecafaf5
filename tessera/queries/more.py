"""Payloads, reconciliation of three sides, reliability, argmax and hashed features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import features as ft
from tessera.operators import keys, panel, policy, similarity
from tessera.plans import payloads as pl
from tessera.plans.views import OUTCOMES_SQL, SCORES_SQL, outcomes, scores
from tessera.queries.panel import rounded
from tessera.queries.registry import Registry
from tessera.session import table

Q = Registry()


@Q.query(r"""
    WITH t AS (SELECT conv_id, turn, role, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS summary,
                      list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM conversations)
    SELECT conv_id, turn, md5(trim(regexp_replace(array_to_string(list_filter(list_concat([summary], coalesce(history, []), [text]), lambda p: coalesce(p, '') <> ''), chr(10)), '\s+', ' ', 'g'))) AS query FROM t WHERE role = 'user'
""")
def context_queries(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("summary", F.first("text").over(w)).withColumn("history", F.collect_list("text").over(w.rowsBetween(-3, -1)))
    return t.where("role = 'user'").select("conv_id", "turn", F.md5(pl.context_query(F.col("text"), F.col("history"), F.col("summary"))).alias("query"))


@Q.query("""
    SELECT conv_id, md5('{"items":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '","selected":' || (turn % 3 = 0) || '}', ',' ORDER BY turn) || ']}') AS timeline,
           md5('{"items":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) FILTER (turn % 3 = 0) || ']}') AS chosen FROM conversations GROUP BY 1
""")
def selection_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The timeline with what was selected, and the selected items alone."""
    t = table(spark, d, "conversations")
    hit = F.col("turn") % 3 == 0
    a = pl.items_payload(t, "conv_id", ["turn"], ["turn", "role"], hit).select("conv_id", F.md5("payload").alias("timeline"))
    b = pl.items_payload(t, "conv_id", ["turn"], ["turn", "role"], hit, only=True).select("conv_id", F.md5("payload").alias("chosen"))
    return a.join(b, "conv_id", "left")


@Q.query("""
    SELECT event_id, '{"context":"' || event_type || '","response_A":"' || CASE WHEN event_id % 2 = 1 THEN user_id % 5 ELSE event_id % 7 END || '","response_B":"' || CASE WHEN event_id % 2 = 1 THEN event_id % 7 ELSE user_id % 5 END || '"}' AS payload FROM events
""")
def blind_payloads(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 7).cast("string").alias("x"), (F.col("user_id") % 5).cast("string").alias("y"))
    return e.select("event_id", pl.blind_pairs(e, "event_type", "x", "y", F.col("event_id") % 2 == 1).alias("payload"))


@Q.query(f"""
    WITH {SCORES_SQL}, s AS (SELECT unit, variant, condition, max(event_id) AS r, max((unit * 3 + variant) % 5 + CASE WHEN unit % 10 = 0 THEN length(condition) ELSE 0 END) AS p FROM scores WHERE condition IN ('click', 'view', 'error') GROUP BY 1, 2, 3),
    c AS (SELECT unit, variant, count(DISTINCT p) = 1 AS same, any_value(p) AS p, max(CASE WHEN condition = 'error' THEN r END) AS a, max(CASE WHEN condition = 'view' THEN r END) AS b FROM s WHERE condition <> 'click' GROUP BY 1, 2),
    w AS (SELECT *, bool_and(same AND a IS NOT NULL AND b IS NOT NULL) OVER (PARTITION BY unit) AS ok FROM c)
    SELECT unit, '{{"cases":[' || string_agg('{{"variant":' || variant || ',"p":' || p || ',"response_A":' || a || ',"response_B":' || b || '}}', ',' ORDER BY variant) || ']}}' AS payload FROM w WHERE ok GROUP BY 1
""")
def fixed_case_payloads(spark: SparkSession, d: str) -> DataFrame:
    p = (F.col("unit") * 3 + F.col("variant")) % 5 + F.when(F.col("unit") % 10 == 0, F.length("condition")).otherwise(0)
    s = scores(spark, d).groupBy("unit", "variant", "condition").agg(F.max("event_id").alias("r"), F.max(p).alias("p"))
    return pl.fixed_cases(s, "unit", "condition", "variant", ["p"], "r", ["error", "view"])


@Q.query("""
    WITH e AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber <= 3), a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber = 2),
    u AS (SELECT k, 1 AS e, 0 AS a, 0 AS b FROM e UNION ALL SELECT k, 0, 1, 0 FROM a UNION ALL SELECT k, 0, 0, 1 FROM b), g AS (SELECT k, sum(e) AS e, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1)
    SELECT side, missing, extra, duplicates, missing + extra + duplicates = 0 AS ok FROM (
      SELECT 'judgments' AS side, count(*) FILTER (e > 0 AND a = 0) AS missing, count(*) FILTER (e = 0 AND a > 0) AS extra, count(*) FILTER (a > 1) AS duplicates FROM g
      UNION ALL SELECT 'scores', count(*) FILTER (e > 0 AND b = 0), count(*) FILTER (e = 0 AND b > 0), count(*) FILTER (b > 1) FROM g)
""")
def reconciled_sides(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    want = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("k")).distinct()
    sides = {"judgments": table(spark, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("k")), "scores": li.where("l_linenumber = 2").select(F.col("l_orderkey").alias("k"))}
    return keys.reconcile_sides(want, sides, ["k"])


@Q.query(f"""
    WITH {SCORES_SQL} SELECT condition, count(*) AS n, round(avg((rating >= 2)::INT), 6) AS reliable_rate, avg((rating >= 2)::INT) >= 0.8 AS ok FROM scores GROUP BY 1
""")
def reliability_gate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(keys.reliable_rates(scores(spark, d), ["condition"], F.col("rating") >= 2, 0.8))


@Q.query(f"""
    WITH {OUTCOMES_SQL}, u AS (SELECT card_id, action_id, round(response - 0.5::DOUBLE * greatest(misuse, omission) - 0.1::DOUBLE * cost / 50, 6) AS u FROM outcomes),
    b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY u DESC, action_id) = 1)
    SELECT action_id, count(*) AS states, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(u), 4) AS mean_utility FROM b GROUP BY 1
""")
def best_utility_shares(spark: SparkSession, d: str) -> DataFrame:
    """Which action has the greatest utility, over states."""
    u = F.round(F.col("response") - 0.5 * F.greatest("misuse", "omission") - 0.1 * F.col("cost") / 50, 6)
    best = policy.best_rows(outcomes(spark, d).select("card_id", "action_id", u.alias("u")), ["card_id"], [-F.col("u"), F.col("action_id")])
    return rounded(panel.value_shares(best, "action_id", states=F.count("*"), mean_utility=F.round(F.avg("u"), 4)))


@Q.query("""
    WITH g AS (SELECT event_type AS condition, user_id, count(*) AS turns, sum(value) AS tokens, avg(value) AS risk FROM events GROUP BY 1, 2)
    SELECT condition, count(*) AS dialogues, round(avg(risk), 6) AS mean_risk, round(avg(tokens), 6) AS mean_tokens, round(avg(turns), 6) AS mean_turns FROM g GROUP BY 1
""")
def dialogue_costs(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a dialogue first, then their means over dialogues."""
    e = table(spark, d, "events")
    return rounded(panel.dialogue_totals(e, "event_type", "user_id", "value", "value").withColumnRenamed("event_type", "condition"))


@Q.query("""
    SELECT event_id, regexp_matches('try ' || event_type || CASE WHEN event_id % 9 = 0 THEN ' mpe+rs now' WHEN event_id % 9 = 1 THEN ' XM0+R0' ELSE '' END, '(?i)\\b(M0|MP|MS|ME|MPMS|MPE|MSE|MPMSME)\\+(R0|RS)\\b') AS leaks FROM events
""")
def action_code_leaks(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("event_id") % 9 == 0, " mpe+rs now").when(F.col("event_id") % 9 == 1, " XM0+R0").otherwise("")
    return table(spark, d, "events").select("event_id", text.has_action_code(F.concat(F.lit("try "), "event_type", tail)).alias("leaks"))


_G = """SELECT DISTINCT id, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i
    FROM (SELECT {id} AS id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9'']+') AS t FROM {table}) WHERE len(t) > 0)"""


@Q.query(f"""
    WITH l AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1),
    f AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9'']+'), ' ') AS form FROM documents),
    e AS (SELECT DISTINCT a.doc_id FROM f a JOIN f b ON md5(a.form) = md5(b.form) AND a.form <> '' AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1),
    g AS ({_G.format(id='doc_id', table='l')}), h AS ({_G.format(id='doc_id', table='r')}), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), m AS (SELECT id, count(*) AS n FROM h GROUP BY 1),
    p AS (SELECT g.id AS a, h.id AS b, count(*) AS k FROM g JOIN h USING (s) GROUP BY 1, 2),
    j AS (SELECT a, max(k / (n.n + m.n - k)) AS j FROM p JOIN n ON n.id = a JOIN m ON m.id = b GROUP BY 1)
    SELECT doc_id, 'exact' AS reason, 1.0::DOUBLE AS similarity FROM e UNION ALL SELECT a, 'similar', round(j, 6) FROM j WHERE j >= 0.88 AND a NOT IN (SELECT doc_id FROM e)
""")
def overlaps_between(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one side that the other side has, exactly or nearly, with the reason."""
    docs = table(spark, d, "documents")
    return rounded(similarity.overlaps(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "text"))


@Q.query("""
    WITH w AS (SELECT conv_id * 100 + turn AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS w FROM conversations),
    g AS (SELECT id, ('0x' || substr(md5(substr(' ' || w || ' ', i, n)), 1, 8))::BIGINT % 64 AS bucket FROM w, (SELECT unnest([3, 4, 5]) AS n), LATERAL (SELECT unnest(range(1, greatest(length(w) + 4 - n, 1))) AS i)),
    c AS (SELECT id, bucket, count(*) AS c FROM g GROUP BY 1, 2)
    SELECT id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY id)), 6) AS weight FROM c
""")
def char_gram_hashes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return rounded(ft.char_gram_hashes(t, "id", "text", 64))


@Q.query("""
    WITH q AS (SELECT quantile_cont(l_quantity, 0.01) AS ql, quantile_cont(l_quantity, 0.99) AS qh, quantile_cont(l_extendedprice, 0.01) AS pl, quantile_cont(l_extendedprice, 0.99) AS ph FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
    s AS (SELECT l_orderkey, l_linenumber, (greatest(greatest(0, ql - l_quantity) / greatest(abs(ql), 1), greatest(0, l_quantity - qh) / greatest(abs(qh), 1))
           + greatest(greatest(0, pl - l_extendedprice) / greatest(abs(pl), 1), greatest(0, l_extendedprice - ph) / greatest(abs(ph), 1))) / 2 AS s FROM lineitem, q)
    SELECT l_orderkey, l_linenumber, round(s, 6) AS excess, s > 0.05 AS severe FROM s WHERE s > 0
""")
def band_excess(spark: SparkSession, d: str) -> DataFrame:
    """How far rows lie outside the 1-99 % band of the training rows."""
    li = table(spark, d, "lineitem")
    got = ft.band_report(li, li.where("l_shipdate < timestamp '1998-01-01'"), ["l_quantity", "l_extendedprice"], severe=0.05)
    return rounded(got.where("excess > 0").select("l_orderkey", "l_linenumber", "excess", "severe"))


@Q.query("""
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY 1 LIMIT 40)
""")
def first_cards(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the chosen actions of the first 40 cards that have one: the list is a feature of the sweep."""
    return keys.first_keys(table(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_orderkey", 40).select("l_orderkey", "l_linenumber")
