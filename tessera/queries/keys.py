"""Uniqueness, resume, reconciliation, validation and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import keys
from tessera.queries.registry import Registry
from tessera.session import table

Q = Registry()


@Q.query("""
    SELECT l_orderkey, l_linenumber, count(*) AS n, CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 'null' ELSE 'duplicate' END AS reason
    FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL
""")
def key_violations(spark: SparkSession, d: str) -> DataFrame:
    return keys.key_violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@Q.query("""
    SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return keys.pending(table(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderpriority")


@Q.query("""
    SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
""")
def stale_labels(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "documents").where("lang = 'en'")
    return keys.null_safe_join(keys.done_keys(table(spark, d, "labels"), ["doc_id"]), expected, ["doc_id"], "left_anti")


@Q.query("""
    WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY 1, 2),
    o AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE day(ts) > 15 GROUP BY 1, 2)
    SELECT sum(e.n)::BIGINT AS expected_rows, sum(o.n)::BIGINT AS observed_rows, count(*) FILTER (o.n IS NULL) AS missing, count(*) FILTER (e.n IS NULL) AS extra,
           count(*) FILTER (o.n > 1) AS duplicates, count(*) FILTER (o.n IS NULL) = 0 AND count(*) FILTER (e.n IS NULL) = 0 AND count(*) FILTER (o.n > 1) = 0 AND sum(e.n) = sum(o.n) AS ok
    FROM e FULL JOIN o USING (user_id, event_type)
""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return keys.reconcile(e.where("day(ts) <= 15"), e.where("day(ts) > 15"), ["user_id", "event_type"])


@Q.query("""
    SELECT unnest(list_filter([CASE WHEN coalesce(l_quantity BETWEEN 1 AND 45, false) THEN NULL ELSE 'quantity within bounds' END,
                   CASE WHEN coalesce(l_discount = 0 OR l_tax > 0, false) THEN NULL ELSE 'discount needs tax' END,
                   CASE WHEN coalesce(l_returnflag IN ('A', 'R', 'N'), false) THEN NULL ELSE 'closed set of flags' END,
                   CASE WHEN coalesce(l_returnflag <> 'R' OR l_quantity > 0, false) THEN NULL ELSE 'returns have quantity' END], lambda x: x IS NOT NULL)) AS rule,
           l_orderkey::VARCHAR AS key, l_linenumber::VARCHAR AS detail
    FROM lineitem
""")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "quantity within bounds": F.col("l_quantity").between(1, 45),
        "discount needs tax": (F.col("l_discount") == 0) | (F.col("l_tax") > 0),
        "closed set of flags": F.col("l_returnflag").isin("A", "R", "N"),
        "returns have quantity": (F.col("l_returnflag") != "R") | (F.col("l_quantity") > 0),
    }
    return keys.rule_violations(table(spark, d, "lineitem"), F.col("l_orderkey"), rules, F.col("l_linenumber"))


_SPLIT = """
    s AS (SELECT doc_id, text, source, CASE WHEN u < 0.70 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split,
                 array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9'']+'), ' ') AS form
          FROM (SELECT *, ('0x' || substr(sha256('17' || chr(31) || doc_id), 1, 12))::BIGINT / 281474976710656.0 AS u FROM documents))
"""


def _split_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", ids.split_of(F.lit(17), "doc_id").alias("split"), F.md5(text.normalize_for_hash(F.col("text"))).alias("form"))


@Q.query(f"""
    WITH {_SPLIT}, v AS (SELECT DISTINCT 'form' AS kind, form AS v, split FROM s UNION SELECT DISTINCT 'source', source, split FROM s WHERE source IS NOT NULL)
    SELECT a.kind, a.split AS left_split, b.split AS right_split, count(*) AS overlap FROM v a JOIN v b ON a.kind = b.kind AND a.v = b.v AND a.split < b.split GROUP BY 1, 2, 3
""")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    return keys.split_leakage(_split_documents(spark, d), "split", ["form", "source"])


@Q.query("""
    WITH q AS (SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL), t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
    SELECT 'quality' AS head, count(*) AS expected, count(q.doc_id) AS labelled, count(*) - count(q.doc_id) AS missing FROM documents d LEFT JOIN q USING (doc_id)
    UNION ALL SELECT 'toxic', count(*), count(t.doc_id), count(*) - count(t.doc_id) FROM documents d LEFT JOIN t USING (doc_id)
""")
def label_completeness(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    heads = {"quality": labels.where("quality is not null"), "toxic": labels.where("toxic = 1")}
    return keys.completeness(table(spark, d, "documents"), heads, ["doc_id"])


@Q.query("""
    SELECT l_orderkey, count(*) AS n, count(DISTINCT (l_returnflag, l_linestatus)) AS variants FROM lineitem GROUP BY 1
    HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1
""")
def context_signatures(spark: SparkSession, d: str) -> DataFrame:
    return keys.inconsistent_groups(table(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@Q.query("""
    SELECT event_id, 'gold_label' AS field FROM events WHERE value > 90 UNION ALL SELECT event_id, 'oracle_answer' FROM events WHERE event_type = 'purchase' AND user_id % 7 = 0
""")
def forbidden_fields(spark: SparkSession, d: str) -> DataFrame:
    """Objects of which some hold what only an evaluator may see, one of them in a nested object."""
    inner = F.struct(F.col("event_type").alias("kind"), F.when(F.col("value") > 90, F.col("value")).alias("gold_label"))
    answer = F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 7 == 0), F.col("props"))
    e = table(spark, d, "events").withColumn("o", F.to_json(F.struct("user_id", inner.alias("judge"), answer.alias("oracle_answer"))))
    return keys.forbidden_fields(e, "o", "event_id", ["gold", "oracle"])


@Q.query("""
    SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'token =') OR contains(lower(text), 'licensed under') OR contains(lower(text), 'copyright')
""")
def marker_filter(spark: SparkSession, d: str) -> DataFrame:
    marks = ("token =", "licensed under", "copyright")
    hit = F.array_contains(F.array(*[F.lower("text").contains(m) for m in marks]), True)
    return table(spark, d, "documents").where(hit).select("doc_id", "lang")


@Q.query("""
    SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate
""")
def causality_violations(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return late.where("l_shipdate <= o_orderdate").select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")


@Q.query("""
    SELECT conv_id, turn, 'mem_' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::VARCHAR, 3, '0') AS opaque_id FROM conversations
""")
def opaque_turn_ids(spark: SparkSession, d: str) -> DataFrame:
    return keys.opaque_ids(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], "mem")


@Q.query("""
    SELECT conv_id, list_sort(list(DISTINCT role)) = ['assistant', 'user'] AS exact_roles, count(*) = count(DISTINCT turn) AS unique_turns,
           max(turn) + 1 = count(*) AS whole FROM conversations GROUP BY 1
""")
def set_checks(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.collect_set("role").alias("r"), F.count("*").alias("n"), F.count_distinct("turn").alias("k"), F.max("turn").alias("m")
    )
    exact = keys.same_set(F.col("r"), F.array(F.lit("user"), F.lit("assistant")))
    return g.select("conv_id", exact.alias("exact_roles"), F.expr("n = k").alias("unique_turns"), F.expr("m + 1 = n").alias("whole"))


@Q.query("""
    SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t
    WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type AND day(e.ts) <= 10)
""")
def missing_matrix_cells(spark: SparkSession, d: str) -> DataFrame:
    """Units by conditions that have no row: the few conditions are exploded per unit, not cross-joined."""
    e = table(spark, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]
    cells = e.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, sorted(kinds)))).alias("event_type"))
    return keys.pending(cells, e.where("day(ts) <= 10"), ["user_id", "event_type"])
