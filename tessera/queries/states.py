"""States, variants, payloads, label audits, controls, budgets and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import policy as po
from tessera.plans import states as st
from tessera.queries.panel import rounded
from tessera.queries.policy import _F, facts
from tessera.queries.registry import Registry
from tessera.session import table
from tessera.sources.lineage import digest, manifest
from tessera.streaming import events as stream

Q = Registry()

_EST = "greatest(1, ceil(length(coalesce(text, '')) / 4))::BIGINT"
_INV = ", ".join(
    f"count(*) FILTER (role = '{r}') OVER w AS {s}_count, turn - max(CASE WHEN role = '{r}' THEN turn END) OVER w AS {s}_newest, "
    f"turn - min(CASE WHEN role = '{r}' THEN turn END) OVER w AS {s}_oldest, coalesce(sum(CASE WHEN role = '{r}' THEN {_EST} END) OVER w, 0)::BIGINT AS {s}_tokens"
    for r, s in st.SOURCE_OF.items()
)
_STATES = f"""t AS (SELECT *, {_INV} FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    states AS (SELECT 'state_' || substr(sha256(conv_id || chr(31) || turn), 1, 16) AS state_id, *, ((MP_count > 0)::INT + 2 * (MS_count > 0)::INT + 4 * (ME_count > 0)::INT)::INT AS available FROM t WHERE role = 'user')"""
_INV_COLS = ", ".join(f"coalesce({s}_{c}, -1) AS {s}_{c}" for s in ("MP", "MS", "ME") for c in ("count", "newest", "oldest", "tokens"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


@Q.query(f"WITH {_STATES} SELECT state_id, conv_id, turn, available, {_INV_COLS}, (2 * power(2, bit_count(available)))::BIGINT AS n_actions FROM states")
def runtime_states(spark: SparkSession, d: str) -> DataFrame:
    return st.runtime_states(turns(spark, d)).fillna(-1)


_PLAN_ROWS = ", ".join(f"('{n}', {m})" for n, m in st.PLANS.items())


@Q.query(f"""
    WITH {_STATES}, p(plan, mask) AS (VALUES {_PLAN_ROWS})
    SELECT 'card_' || substr(sha256(state_id || chr(31) || plan), 1, 16) AS card_id, state_id, plan, mask FROM states JOIN p ON mask & available = mask
""")
def inventory_variants(spark: SparkSession, d: str) -> DataFrame:
    return st.variants(st.runtime_states(turns(spark, d)))


@Q.query(f"""
    WITH {_STATES}, p AS (SELECT unnest(range(8))::INT AS mask) SELECT available, count(*) AS cards, count(DISTINCT state_id) AS states FROM states JOIN p ON mask & available = mask GROUP BY 1
""")
def subset_cards(spark: SparkSession, d: str) -> DataFrame:
    s = st.runtime_states(turns(spark, d))
    v = st.every_subset(s).join(s.select("state_id", "available"), "state_id")
    return v.groupBy("available").agg(F.count("*").alias("cards"), F.count_distinct("state_id").alias("states"))


@Q.query("""
    SELECT conv_id, to_json(list({'turn': turn, 'role': role, 'selected': role = 'assistant'} ORDER BY turn))::VARCHAR AS payload FROM conversations GROUP BY 1
""")
def timeline_payloads(spark: SparkSession, d: str) -> DataFrame:
    return st.timeline_payload(turns(spark, d))


@Q.query("""
    SELECT conv_id, CASE role WHEN 'user' THEN 'MP' WHEN 'system' THEN 'MS' ELSE 'ME' END AS source, turn AS created_session, 'mem_' || substr(sha256(conv_id || chr(31) || role || chr(31) || turn), 1, 16) AS memory_id FROM conversations
""")
def memory_items(spark: SparkSession, d: str) -> DataFrame:
    return st.memory_items(turns(spark, d))


@Q.query(f"""
    WITH {_STATES} SELECT state_id, MP_count > 0 AS mp, ME_count AS me, CASE WHEN MS_count > 0 THEN MS_tokens ELSE 0 END AS ms_tokens FROM states
""")
def second_schema(spark: SparkSession, d: str) -> DataFrame:
    v2 = st.as_v2(st.runtime_states(turns(spark, d)))
    return v2.select("state_id", F.col("inventory.MP.available").alias("mp"), F.col("inventory.ME.count").alias("me"), F.col("inventory.MS.tokens").alias("ms_tokens"))


@Q.query("""
    SELECT lang, count(*) AS n, round(avg(quality), 6) AS good, round(avg(toxic), 6) AS toxic, avg(quality) >= 0.8 AS good_gate, avg(toxic) <= 0.2 AS toxic_gate, count(DISTINCT source) AS sources
    FROM documents JOIN labels USING (doc_id) GROUP BY 1
""")
def label_audit(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    g = j.groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("good"), F.avg("toxic").alias("toxic"), F.count_distinct("source").alias("sources"))
    return rounded(g.withColumn("good_gate", F.col("good") >= 0.8).withColumn("toxic_gate", F.col("toxic") <= 0.2))


@Q.query("""
    WITH h AS (SELECT o_orderpriority AS regime, o_orderstatus AS action, count(*) AS n, avg((o_totalprice > 200000)::INT) AS pass FROM orders GROUP BY 1, 2)
    SELECT regime, sum(n)::BIGINT AS states, round(max(n) / sum(n), 6) AS top_share, round(sum(pass * n) / sum(n), 6) AS pass_rate FROM h GROUP BY 1
""")
def regime_alignment(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    h = o.groupBy(F.col("o_orderpriority").alias("regime"), "o_orderstatus").agg(F.count("*").alias("n"), F.sum((F.col("o_totalprice") > 200000).cast("double")).alias("p"))
    n = F.sum("n")
    return rounded(h.groupBy("regime").agg(n.alias("states"), (F.max("n") / n).alias("top_share"), (F.sum("p") / n).alias("pass_rate")))


@Q.query("""
    WITH e(event_type, field, lo, hi) AS (VALUES ('view', 'value', 10.0, 90.0), ('click', 'value', 0.0, 50.0), ('click', 'k', 20.0, 80.0)),
    l AS (SELECT event_type, 'value' AS field, value AS x FROM events UNION ALL SELECT event_type, 'k', (props::JSON->>'k')::DOUBLE FROM events)
    SELECT event_type, field, count(*) AS n, round(avg((x BETWEEN lo AND hi)::INT), 6) AS accuracy FROM l JOIN e USING (event_type, field) GROUP BY 1, 2
""")
def rate_controls(spark: SparkSession, d: str) -> DataFrame:
    want = [("view", "value", 10.0, 90.0), ("click", "value", 0.0, 50.0), ("click", "k", 20.0, 80.0)]
    e = spark.createDataFrame(want, "event_type string, field string, lo double, hi double")
    fields = F.array(F.struct(F.lit("value").alias("field"), F.col("value").alias("x")), F.struct(F.lit("k").alias("field"), F.get_json_object("props", "$.k").cast("double").alias("x")))
    long = table(spark, d, "events").select("event_type", F.explode(fields).alias("f")).select("event_type", "f.*")
    met = long.join(F.broadcast(e), ["event_type", "field"])
    return rounded(met.groupBy("event_type", "field").agg(F.count("*").alias("n"), F.avg(F.col("x").between(F.col("lo"), F.col("hi")).cast("double")).alias("accuracy")))


@Q.query("""
    WITH f AS (SELECT event_type, user_id % 5 AS fold, count(*) AS n, (max(event_id) % 4)::BIGINT AS eps FROM events GROUP BY 1, 2)
    SELECT event_type, min(eps) FILTER (c = m) AS voted, median(eps) AS middle, round(sum(eps * n) / sum(n), 6) AS weighted
    FROM (SELECT *, max(c) OVER (PARTITION BY event_type) AS m FROM (SELECT *, count(*) OVER (PARTITION BY event_type, eps) AS c FROM f)) GROUP BY 1
""")
def threshold_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Over folds: the most frequent value (the least of several), the median, and the mean weighted by size."""
    f = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("fold")).agg(F.count("*").alias("n"), (F.max("event_id") % 4).alias("eps"))
    votes = f.groupBy("event_type", "eps").agg(F.count("*").alias("c"))
    top = votes.groupBy("event_type").agg(F.min_by("eps", F.struct(-F.col("c"), "eps")).alias("voted"))
    g = f.groupBy("event_type").agg(F.median("eps").alias("middle"), (F.sum(F.col("eps") * F.col("n")) / F.sum("n")).alias("weighted"))
    return rounded(g.join(top, "event_type"))


@Q.query("""
    WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_type IN ('purchase', 'error')),
    c AS (SELECT *, CASE WHEN k = 1 THEN 'target' ELSE 'omission' END AS kind FROM r WHERE k <= 2)
    SELECT event_id, user_id, event_type, kind FROM c WHERE kind = 'target' UNION ALL SELECT * FROM (SELECT event_id, user_id, event_type, kind FROM c WHERE kind = 'omission' ORDER BY event_id LIMIT 12)
""")
def audit_calls(spark: SparkSession, d: str) -> DataFrame:
    """Two calls per user and focus condition: a target, and an omission, of which the plan takes twelve in all."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    c = table(spark, d, "events").where("event_type in ('purchase', 'error')").select("event_id", "user_id", "event_type", k.alias("k")).where("k <= 2")
    c = c.select("event_id", "user_id", "event_type", F.when(F.col("k") == 1, "target").otherwise("omission").alias("kind"))
    return c.where("kind = 'target'").unionByName(c.where("kind = 'omission'").orderBy("event_id").limit(12))


@Q.query("""
    SELECT count(*) AS calls, sum(ceil(length(text) / 4))::BIGINT AS tokens, round(sum(ceil(length(text) / 4)) * 0.3 / 1000000, 9) AS price, sum(ceil(length(text) / 4)) <= 1000000 AS tokens_ok, count(*) <= 500 AS calls_ok FROM conversations
""")
def budget_gate(spark: SparkSession, d: str) -> DataFrame:
    t = F.sum(F.ceil(F.length("text") / 4))
    return turns(spark, d).agg(F.count("*").alias("calls"), t.alias("tokens"), F.round(t * 0.3 / 1_000_000, 9).alias("price"), (t <= 1_000_000).alias("tokens_ok"), (F.count("*") <= 500).alias("calls_ok"))


@Q.query(f"""
    WITH {_F}, g AS (SELECT f.*, z, mr, cw FROM f, (SELECT unnest([0.5, 1.0, 1.64])::DOUBLE AS z), (SELECT unnest([0.5, 0.7])::DOUBLE AS mr), (SELECT unnest([0.001, 0.004])::DOUBLE AS cw)),
    s AS (SELECT *, greatest(0, response - z * (cost / 500)) AS lcb, least(1, greatest(misuse, omission) + z * (cost / 500)) AS ucb, max(CASE WHEN action_id = 'M0+R0' THEN response END) OVER (PARTITION BY card_id, z, mr, cw) AS base FROM g),
    k AS (SELECT *, ucb <= mr AND lcb >= coalesce(base, 0) AND action_id <> 'M0+R0' AS ok, lcb - cw * cost AS utility FROM s),
    c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY card_id, z, mr, cw ORDER BY ok DESC, (action_id = 'M0+R0') DESC, utility DESC, lcb DESC, ucb, cost, action_id DESC) = 1)
    SELECT z, mr, cw, count(*) AS states, round(avg(response), 6) AS response, round(avg((NOT ok)::INT), 6) AS fallback_rate, round(avg(response) - 0.5 * avg(greatest(misuse, omission)) - avg(cost) / 500, 6) AS objective FROM c GROUP BY 1, 2, 3
""")
def bounded_grid(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("std", F.col("cost") / 500)
    c = po.lcb_grid(f, ["card_id"], {"z": [0.5, 1.0, 1.64], "mr": [0.5, 0.7], "cw": [0.001, 0.004]}, "M0+R0")
    objective = F.avg("response") - 0.5 * F.avg(F.greatest("misuse", "omission")) - F.avg("cost") / 500
    return rounded(c.groupBy("z", "mr", "cw").agg(F.count("*").alias("states"), F.avg("response").alias("response"), F.avg(F.col("fallback").cast("double")).alias("fallback_rate"), objective.alias("objective")))


@Q.query("""
    SELECT ts::DATE::VARCHAR AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2
""")
def stream_daily_means(spark: SparkSession, d: str) -> DataFrame:
    """A stream over the events, drained; the windows of complete mode are those of a batch."""
    s = stream.windowed_means(stream.event_stream(spark, f"{d}/events.parquet*"))
    out = stream.drained(s, *stream_folders(spark), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@Q.query("SELECT count(*) AS events, count(DISTINCT event_id) AS ids FROM events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Two copies of the stream of events, each event once."""
    e = stream.event_stream(spark, f"{d}/events.parquet*")
    out = stream.drained(stream.first_seen(e.unionByName(stream.event_stream(spark, f"{d}/events.parquet*"))), *stream_folders(spark))
    return out.agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


@Q.query("""
    WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, round(sum(value), 6) AS total
    FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)
""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The sessions that the watermark has closed."""
    s = stream.sessions(stream.event_stream(spark, f"{d}/events.parquet*"))
    out = stream.drained(s, *stream_folders(spark))
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")]
    return out.select("user_id", *shown, "n", F.round("total", 6).alias("total"))


@Q.query()
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: number, bytes and digest of the folder's files."""
    return digest(manifest(spark, d))


def stream_folders(spark: SparkSession) -> tuple[str, str]:
    """A table and a checkpoint for a stream, in the shared folder."""
    from tessera.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/checkpoint"


@Q.query("""
    WITH q AS (SELECT quantile_cont(l_quantity, 0.5) AS qm, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS qs, quantile_cont(l_extendedprice, 0.5) AS pm, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS ps
               FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')
    SELECT l_orderkey, round(avg((l_quantity - qm) / qs), 6) + 0 AS l_quantity, round(avg((l_extendedprice - pm) / ps), 6) + 0 AS l_extendedprice FROM lineitem, q GROUP BY 1
""")
def robust_scaled(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.features import robust_scaled as scaled

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate")
    s = scaled(rows, rows.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")), ["l_quantity", "l_extendedprice"])
    # Adding zero makes a negative zero positive.
    means = [(F.round(F.avg(c), 6) + 0.0).alias(c) for c in ("l_quantity", "l_extendedprice")]
    return s.groupBy("l_orderkey").agg(*means)


@Q.query(f"""
    WITH {_STATES}, p(plan, mask) AS (VALUES {_PLAN_ROWS}), v AS (SELECT state_id, conv_id, plan, mask FROM states JOIN p ON mask & available = mask),
    s AS (SELECT state_id, any_value(conv_id) AS conv_id, count(*) AS n FROM v GROUP BY 1)
    SELECT count(*) AS states, count(DISTINCT conv_id) AS users, sum(n)::BIGINT AS cards, count(*) FILTER (n < 2) AS single_variant, (SELECT count(*) FROM (SELECT mask FROM v GROUP BY 1 HAVING count(DISTINCT state_id) >= 2)) AS reused_signatures FROM s
""")
def release_audit(spark: SparkSession, d: str) -> DataFrame:
    states = st.runtime_states(turns(spark, d)).select("state_id", "conv_id", "available")
    v = st.variants(states)
    s = v.groupBy("state_id").agg(F.count("*").alias("n")).join(states, "state_id")
    counts = s.agg(F.count("*").alias("states"), F.count_distinct("conv_id").alias("users"), F.sum("n").alias("cards"), F.count_if(F.col("n") < 2).alias("single_variant"))
    reused = v.groupBy("mask").agg(F.count_distinct("state_id").alias("k")).agg(F.count_if(F.col("k") >= 2).alias("reused_signatures"))
    return counts.join(F.broadcast(reused))


@Q.query("""
    SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS regimes, array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(list(event_type), x))), ',') AS missing
    FROM events GROUP BY 1
""")
def bundle_check(spark: SparkSession, d: str) -> DataFrame:
    """Per user, which of the required regimes have no case."""
    need = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.collect_set("event_type").alias("has"))
    return g.select("user_id", "n", F.size("has").cast("long").alias("regimes"), F.array_join(F.array_sort(F.array_except(need, F.col("has"))), ",").alias("missing"))


@Q.query("""
    WITH p AS (SELECT ts::DATE AS day, user_id, count(DISTINCT event_type) AS k FROM events GROUP BY 1, 2)
    SELECT day(day)::INT AS day_of_month, count(*) AS units, count(*) FILTER (k > 1) AS several, round(avg(k), 6) AS mean_actions FROM p GROUP BY 1
""")
def several_actions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy(F.day("ts").alias("day_of_month"), "user_id").agg(F.count_distinct("event_type").alias("k"))
    return rounded(p.groupBy("day_of_month").agg(F.count("*").alias("units"), F.count_if(F.col("k") > 1).alias("several"), F.avg("k").alias("mean_actions")))


@Q.query("""
    WITH w AS (SELECT conv_id * 100 + turn AS id, (conv_id % 8)::INT AS available, regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_]+') AS t FROM conversations WHERE role = 'user'),
    g AS (SELECT id, unnest(t) AS term FROM w UNION ALL SELECT id, t[i] || ' ' || t[i + 1] FROM (SELECT id, t, unnest(range(1, len(t))) AS i FROM w)),
    tf AS (SELECT id, term, count(*) AS n FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df, sum(n) AS total FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 500),
    x AS (SELECT id, term FROM tf JOIN df USING (term)), o AS (SELECT id, unnest(list_filter([CASE WHEN available & 1 > 0 THEN 'MP' END, CASE WHEN available & 2 > 0 THEN 'MS' END, CASE WHEN available & 4 > 0 THEN 'ME' END, 'RS'], lambda v: v IS NOT NULL)) AS gate FROM w)
    SELECT id, gate, count(*) AS terms FROM x JOIN o USING (id) GROUP BY 1, 2
""")
def gated_text_features(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.features import gated_terms, tfidf

    t = turns(spark, d).where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.pmod("conv_id", F.lit(8)).cast("int").alias("available"), "text")
    return gated_terms(tfidf(t, "id", "text", 500, 2), t, "id").groupBy("id", "gate").agg(F.count("*").alias("terms"))
