"""Turns in order: contexts, histories, checkpoints, orders of presentation, first and best rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import stable_hex
from tessera.operators import sequence as s
from tessera.plans.views import OUTCOMES_SQL, outcomes
from tessera.queries.panel import rounded
from tessera.queries.registry import Registry
from tessera.session import table

Q = Registry()


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


@Q.query("""SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text)) AS dialogue FROM conversations GROUP BY 1""")
def dialogue_text(spark: SparkSession, d: str) -> DataFrame:
    return s.dialogue_text(turns(spark, d), "conv_id", "turn", "role", "text").withColumn("dialogue", F.md5("dialogue"))


@Q.query("""
    SELECT conv_id, turn, md5(coalesce(array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), chr(10)), '')) AS context FROM conversations
""")
def preceding_context(spark: SparkSession, d: str) -> DataFrame:
    return s.preceding_context(turns(spark, d), "conv_id", "turn", "role", "text").select("conv_id", "turn", F.md5("context").alias("context"))


@Q.query("""
    SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS last_text FROM conversations
""")
def last_user_text(spark: SparkSession, d: str) -> DataFrame:
    return s.last_of_role(turns(spark, d), "conv_id", "turn", "role", "user", "text").select("conv_id", "turn", F.md5("last_text").alias("last_text"))


@Q.query("""
    WITH h AS (SELECT conv_id, turn, text, list_filter(coalesce(list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []), lambda x: trim(x) <> '') AS h FROM conversations)
    SELECT conv_id, turn, len(g)::BIGINT AS n, md5(array_to_string(g, '|')) AS history FROM (SELECT conv_id, turn, CASE WHEN len(h) > 0 AND h[-1] = text THEN h[1:len(h) - 1] ELSE h END AS g FROM h)
""")
def turn_history(spark: SparkSession, d: str) -> DataFrame:
    h = s.history(turns(spark, d), "conv_id", "turn", "text")
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n"), F.md5(F.array_join("history", "|")).alias("history"))


@Q.query("""
    SELECT conv_id, turn, n_rows, so_far FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n_rows, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations)
    WHERE so_far = greatest(2, n_rows // 2) OR so_far = n_rows
""")
def dialogue_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return s.checkpoints(turns(spark, d).select("conv_id", "turn"), "conv_id", "turn")


@Q.query("""
    WITH t AS (SELECT conv_id, list(md5(text) ORDER BY turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT conv_id, b, array_to_string(list_concat(['hello'], flatten(list_transform(range(1, least(b, len(t)) + 1), lambda i: [t[i], ['why', 'how', 'when'][(i - 1) % 3 + 1]]))), ' ') AS context
    FROM t, (SELECT unnest([0, 1, 2]) AS b)
""")
def fixed_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts before turns 0, 1 and 2: greeting and user turns, each with a cyclic probe."""
    t = turns(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m")))).alias("t"))
    t = t.select("conv_id", F.transform("t", lambda x: x["m"]).alias("t"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("b"))
    return t.select("conv_id", "b", F.array_join(s.fixed_context(F.lit("hello"), F.col("t"), ["why", "how", "when"], F.col("b")), " ").alias("context"))


@Q.query("""
    SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY substr(sha256('5' || chr(31) || event_id), 1, 16), event_id) - 1) % 2 = 0 AS target_first FROM events
""")
def alternated_sides(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type")
    return s.alternated(rows, ["event_type"], [stable_hex(F.lit(5), "event_id"), F.col("event_id")])


@Q.query("""
    WITH c AS (SELECT doc_id, v, CASE WHEN v % 2 = 1 THEN ['f', 'e', 'd', 'c', 'b', 'a'] ELSE ['a', 'b', 'c', 'd', 'e', 'f'] END AS n, ((doc_id + v) % 6)::INT AS k FROM documents, (SELECT unnest([0, 1]) AS v))
    SELECT doc_id, v, array_to_string(list_concat(n[k + 1:6], n[1:k]), '') AS shown FROM c
""")
def balanced_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    names = F.array(*map(F.lit, "abcdef"))
    return rows.select("doc_id", "v", F.array_join(s.balanced_order(names, F.col("doc_id"), F.col("v")), "").alias("shown"))


@Q.query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return s.first_per_key(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@Q.query("""
    WITH t AS (SELECT o_custkey, list(o_totalprice ORDER BY o_totalprice DESC) AS t FROM orders GROUP BY 1) SELECT o_custkey, t[1] AS best, round(t[1] - t[2], 6) AS gap FROM t
""")
def top_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(s.top_gap(table(spark, d, "orders"), ["o_custkey"], "o_totalprice"))


@Q.query(f"""WITH {OUTCOMES_SQL} SELECT card_id, action_id, round(response, 6) AS response FROM outcomes QUALIFY response >= max(response) OVER (PARTITION BY card_id) - 0.1""")
def near_best(spark: SparkSession, d: str) -> DataFrame:
    return rounded(s.near_best(outcomes(spark, d).select("card_id", "action_id", "response"), ["card_id"], "response", 0.1))


@Q.query("""
    SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1
""")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return s.keep_first(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])


@Q.query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def last_writer(spark: SparkSession, d: str) -> DataFrame:
    return s.last_writer(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@Q.query("""
    SELECT o_custkey, count(*) AS n, min(age)::BIGINT AS min_age, max(age)::BIGINT AS max_age, median(age) AS median_age
    FROM (SELECT o_custkey, greatest(0, date_diff('day', l_shipdate::DATE, DATE '2001-01-01')) AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1
""")
def item_ages(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    age = F.greatest(F.lit(0), F.datediff(F.lit("2001-01-01").cast("date"), F.to_date("l_shipdate")))
    g = j.select("o_custkey", age.cast("long").alias("age")).groupBy("o_custkey")
    return g.agg(F.count("*").alias("n"), F.min("age").alias("min_age"), F.max("age").alias("max_age"), F.median("age").alias("median_age"))
