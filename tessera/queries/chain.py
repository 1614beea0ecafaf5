"""Training, scoring and choosing by gates; views of users; steps in order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chain, keys
from tessera.operators.pairgraph import decided_pairs
from tessera.operators.sampling import grouped_folds
from tessera.plans import users as us
from tessera.plans.views import OUTCOMES_SQL, outcomes
from tessera.queries.facts import ACTIONS_SQL
from tessera.queries.newton import newton, product, solved
from tessera.queries.pairs import _EDGES as EDGES_SQL
from tessera.queries.panel import rounded
from tessera.queries.registry import Registry
from tessera.streaming.events import closed_loop
from tessera.session import durable, removed, table
from tessera.sources import models as saved

Q = Registry()


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes with the five labels of the first chain, each a share, and three features."""
    o = outcomes(spark, d)
    return o.select(
        "card_id", "action_id", "user_id", (F.col("cost") / 50).alias("load"), F.col("available").cast("double").alias("sources"), (F.col("flag") == "R").cast("double").alias("flagged"), "response",
        "misuse", F.col("omission").cast("double").alias("omission"), (1 - F.col("misuse")).alias("memory_quality"), (F.col("omission") * F.col("misuse")).alias("strategy_risk"), (F.col("response") / 2 + F.col("cost") / 100).alias("strategy_quality"),
    )


MODES = {"metadata": ["load", "sources"], "all": ["load", "sources", "flagged"]}

_LABELLED = f"""{OUTCOMES_SQL}, {ACTIONS_SQL}, {EDGES_SQL},
    lab AS (SELECT card_id, action_id, user_id, [cost / 50, available, (flag = 'R')::INT]::DOUBLE[] AS x, response, misuse, omission::DOUBLE AS omission, 1 - misuse AS memory_quality, omission * misuse AS strategy_risk,
                   response / 2 + cost / 100 AS strategy_quality, 1.0::DOUBLE / count(*) OVER (PARTITION BY card_id) AS w FROM outcomes),
    e AS (SELECT a.card_id, a.user_id, a.response > b.response AS win, list_transform(range(1, 4), lambda i: a.x[i] - b.x[i]) AS x, 0.5::DOUBLE / count(*) OVER (PARTITION BY a.card_id) AS w
          FROM lab a JOIN edges ON a.action_id = action_a JOIN lab b ON b.card_id = a.card_id AND b.action_id = action_b WHERE a.response <> b.response),
    p AS (SELECT card_id, user_id, w, list_transform(x, lambda q: s * q) AS x, (win = (s > 0))::INT AS y FROM e, (SELECT unnest([1, -1]) AS s)),
    u AS (SELECT card_id, action_id, user_id, x, w, unnest(['misuse', 'omission', 'memory_quality', 'strategy_risk', 'strategy_quality']) AS head,
                 unnest([misuse, omission, memory_quality, strategy_risk, strategy_quality]) AS y FROM lab)"""


def _ridge_sql(rows: str, keys: str) -> str:
    """``keys, b`` (intercept first) of ridge fits of ``y`` on ``x`` with weights ``w``."""
    t = ["1", "x[1]", "x[2]", "x[3]"]
    m = ", ".join("[" + ", ".join([f"sum(w * {a} * {b}) + {5 if a == b != '1' else 0}::DOUBLE" for b in t] + [f"sum(w * {a} * y)"]) + "]" for a in t)
    return f"(SELECT {keys}, list_transform(m, lambda r: r[5]) AS b FROM {solved(f'(SELECT {keys}, [{m}] AS m FROM {rows} GROUP BY {keys})', 4, keys)})"


_GUESS = "greatest(0, least(1, b[1] + b[2] * x[1] + b[3] * x[2] + b[4] * x[3]))"


_SCORED = f"""
    WITH RECURSIVE {_LABELLED}, d AS (SELECT 1 AS k, x, y, w FROM p WHERE card_id % 5 <> 0), {newton("fit", "d", "k", 3)},
    h AS (SELECT card_id, action_id, head, {_GUESS} AS g FROM u JOIN {_ridge_sql("u WHERE card_id % 5 <> 0", "head")} USING (head) WHERE card_id % 5 = 0),
    lo AS (SELECT [min(x[1]), min(x[2]), min(x[3])] AS lo, [max(x[1]), max(x[2]), max(x[3])] AS hi FROM lab WHERE card_id % 5 <> 0),
    s AS (SELECT card_id, action_id, 1 / (1 + exp(-greatest(-30, least(30, {product("v", "x", 3)})))) AS response FROM (SELECT card_id, action_id, list_transform(range(1, 4), lambda i: greatest(lo[i], least(hi[i], x[i]))) AS x FROM lab, lo WHERE card_id % 5 = 0), fit)
    SELECT card_id, action_id, round(response, 6) AS response, {", ".join(f"round(max(g) FILTER (head = '{h}'), 6) AS {h}" for h in chain.HEADS)} FROM s JOIN h USING (card_id, action_id) GROUP BY card_id, action_id, response
"""


@Q.query(_SCORED)
def scored_actions(spark: SparkSession, d: str) -> DataFrame:
    """Six heads fitted on four fifths of the cards, the ranker along the edges of the pair graph, score the actions of the others."""
    rows = durable(labelled(spark, d))
    train = F.col("card_id") % 5 != 0
    model = chain.train_actions(rows, decided_pairs(rows, "card_id", "response"), "card_id", train, MODES["all"])
    scored = model.score_actions(rows.where(~train).select("card_id", "action_id", *MODES["all"]))
    return rounded(scored.drop(*MODES["all"]))


@Q.query(_SCORED)
def saved_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same scores by a model that was saved, attested with the table it was fitted on, and loaded again."""
    rows = durable(labelled(spark, d))
    train = F.col("card_id") % 5 != 0
    model = chain.train_actions(rows, decided_pairs(rows, "card_id", "response"), "card_id", train, MODES["all"])
    path = f"{spark.sparkContext.getCheckpointDir()}/models/{uuid.uuid4().hex}"
    saved.save(spark, model, path, [f"{d}/lineitem.parquet"], {"split": "card_id % 5 <> 0"})
    scorer = saved.Scorer.load(path, kind=chain.ActionModel, inputs=[f"{d}/lineitem.parquet"])
    out = scorer.transform(rows.where(~train).select("card_id", "action_id", *MODES["all"]))
    removed(spark, path)
    return rounded(out.drop(*MODES["all"]))


@Q.query(f"""
    WITH RECURSIVE {_LABELLED}, sz AS (SELECT user_id, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, user_id) AS i FROM lab GROUP BY 1),
    fo AS (SELECT 0::BIGINT AS i, [0, 0, 0]::BIGINT[] AS loads, 0::BIGINT AS fold UNION ALL SELECT i, [CASE WHEN j = pos THEN loads[j] + size ELSE loads[j] END FOR j IN range(1, 4)], pos - 1
           FROM (SELECT sz.i, sz.size, fo.loads, list_position(fo.loads, list_min(fo.loads))::BIGINT AS pos FROM fo JOIN sz ON sz.i = fo.i + 1)),
    fu AS (SELECT user_id, fo.fold AS own FROM sz JOIN fo USING (i)),
    g AS (SELECT k, split_part(k, ' ', 1) AS mode, split_part(k, ' ', 2)::BIGINT AS fold, last FROM (SELECT mode || ' ' || fold AS k, last FROM (VALUES ('metadata', 0), ('all', 1)) m(mode, last), (SELECT unnest([0, 1, 2]) AS fold))),
    px AS (SELECT k, fold = own AS held, [x[1], x[2], x[3] * last]::DOUBLE[] AS x, y, w FROM p JOIN fu USING (user_id), g),
    ux AS (SELECT k || ' ' || head AS kh, k, head, fold = own AS held, [x[1], x[2], x[3] * last]::DOUBLE[] AS x, y, w FROM u JOIN fu USING (user_id), g),
    d AS (SELECT k, x, y, w FROM px WHERE NOT held), {newton("fit", "d", "k", 3)},
    q AS (SELECT k, y, 1 / (1 + exp(-greatest(-30, least(30, {product("v", "x", 3)})))) AS q FROM px JOIN fit USING (k) WHERE held),
    r AS (SELECT k, (count(*) / 2)::BIGINT AS pairs, avg(((q > 0.5) = (y = 1))::INT) AS accuracy, avg(-ln(greatest(1e-9, least(1 - 1e-9, CASE WHEN y = 1 THEN q ELSE 1 - q END)))) AS log_loss FROM q GROUP BY 1),
    h AS (SELECT k, head, avg(abs({_GUESS} - y)) AS mae FROM ux JOIN {_ridge_sql("ux WHERE NOT held", "kh")} USING (kh) WHERE held GROUP BY 1, 2)
    SELECT mode, 1.0::DOUBLE AS c, fold, pairs, round(accuracy, 6) AS accuracy, round(log_loss, 6) AS log_loss, {", ".join(f"round(max(mae) FILTER (head = '{h}'), 6) AS mae_{h}" for h in chain.HEADS)} FROM g JOIN r USING (k) JOIN h USING (k) GROUP BY ALL
""")
def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """Both sets of features over three folds of users."""
    rows = durable(labelled(spark, d))
    folds = durable(grouped_folds(rows, "user_id", 3).select("user_id", "fold"))
    return rounded(chain.cross_validated(rows, decided_pairs(rows, "card_id", "response"), folds, "card_id", "user_id", MODES))


@Q.query()
def ensemble_choices(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: thirteen ensembles of seven members of 180 trees, their bounds, and the choice by gates. Cards whose labels lack a reliable baseline fail the gate and are left out before it."""
    o = outcomes(spark, d)
    pick = lambda k, lo, n: (lo + F.pmod(F.xxhash64("card_id", "action_id", F.lit(k)), F.lit(20)) / 20 + F.col("response") * (n - 1)).alias
    rows = o.select(
        "card_id", "action_id", "cost", "response", F.col("available").cast("double").alias("sources"), (F.col("flag") != "N").alias("reliable"),
        *[pick(i, 1.0, 4)(h) for i, h in enumerate(chain.RATINGS)], *[pick(i + 20, 0.0, 3)(h) for i, h in enumerate(chain.RISKS)],
    )
    whole = rows.where(F.col("reliable")).groupBy("card_id").agg(F.max((F.col("action_id") == chain.BASELINE).cast("int")).alias("b")).where("b = 1")
    rows = durable(rows.join(whole.select("card_id"), "card_id", "left_semi"))
    p = chain.train_ensembles(rows, "card_id", ["cost", "sources"])
    bounds = chain.action_bounds(p, "card_id", dict.fromkeys(chain.RATINGS, 1 / 6)).join(rows.select("card_id", "action_id", "cost"), ["card_id", "action_id"])
    return rounded(chain.gated_choice(bounds, "card_id", max_risk=0.9))


@Q.query(f"""
    WITH {OUTCOMES_SQL}, f AS (SELECT card_id, action_id, split_part(action_id, '+', 1) AS m, split_part(action_id, '+', 2) AS g, cost, round(response - 0.1 * omission, 6) AS lcb, round(response + 0.1 * omission, 6) AS ucb,
            round(greatest(misuse, omission * 0.6), 6) AS risk, round(omission, 6) AS mo, round(misuse, 6) AS so, card_id % 11 = 0 AS severe FROM outcomes),
    b AS (SELECT *, coalesce(max(CASE WHEN action_id = 'M0+R0' THEN action_id END) OVER w, first_value(action_id) OVER (w ORDER BY cost, action_id)) AS base FROM f WINDOW w AS (PARTITION BY card_id)),
    s AS (SELECT *, max(CASE WHEN action_id = base THEN ucb END) OVER w AS bq, max(CASE WHEN action_id = base THEN mo END) OVER w AS bo,
            max(CASE WHEN g = 'R0' THEN ucb END) OVER p AS rq, max(CASE WHEN g = 'R0' THEN so END) OVER p AS ro,
            round(lcb - 0.5::DOUBLE * risk - 0.1::DOUBLE * cost / greatest(max(cost) OVER w, 1), 9) AS utility FROM b WINDOW w AS (PARTITION BY card_id), p AS (PARTITION BY card_id, m)),
    k AS (SELECT *, NOT severe AND risk <= 0.5 AND (m = 'M0' OR round(lcb - bq, 6) >= 0.02::DOUBLE OR bo >= 0.5) AND (g <> 'RS' OR rq IS NULL OR round(lcb - rq, 6) >= 0.02::DOUBLE OR ro >= 0.5) AS ok FROM s)
    SELECT card_id, action_id, round(utility, 6) + 0 AS utility, CASE WHEN severe THEN 'ood' WHEN ok THEN 'chosen' ELSE 'no action passed' END AS reason FROM k
    QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY ok DESC, CASE WHEN NOT ok THEN action_id = base END DESC NULLS LAST, utility DESC, lcb DESC, risk, cost, action_id DESC) = 1
""")
def gated_choices(spark: SparkSession, d: str) -> DataFrame:
    """The choice by gates over bounds made of the outcomes."""
    r = lambda c: F.round(c, 6)
    o, m = F.col("omission"), F.col("misuse")
    bounds = outcomes(spark, d).select(
        "card_id", "action_id", F.col("cost").cast("double").alias("cost"), r(F.col("response")).alias("quality_mean"), r(F.col("response") - 0.1 * o).alias("quality_lcb"), r(F.col("response") + 0.1 * o).alias("quality_ucb"),
        r(F.greatest(m, o * 0.6)).alias("risk_ucb"), r(o).alias("memory_omission_ucb"), r(m).alias("strategy_omission_ucb"),
    )
    return rounded(chain.gated_choice(bounds, "card_id", F.col("card_id") % 11 == 0))


@Q.query("""
    WITH t AS (SELECT *, turn // 4 AS s, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations),
    f AS (SELECT conv_id::VARCHAR AS u, count(*) AS n, CASE min_by(role, turn) WHEN 'user' THEN 'seeker' ELSE 'supporter' END AS r FROM t GROUP BY 1),
    i AS (SELECT u, 'MP' AS source, 'turn_count' AS key, 0 AS session, 'Turn Count: ' || n AS text FROM f UNION ALL SELECT u, 'MP', 'first_role', 0, 'First Role: ' || r FROM f
          UNION ALL SELECT conv_id::VARCHAR, 'MS', 's' || s, s + 1, min_by(x, turn) FROM t GROUP BY conv_id, s
          UNION ALL SELECT conv_id::VARCHAR, 'ME', 's' || s, s + 1, string_agg(x, ' ' ORDER BY turn) FILTER (role = 'user' AND x <> '') FROM t GROUP BY conv_id, s)
    SELECT u AS user_id, 'mem_' || substr(sha256('evo' || chr(31) || u || chr(31) || source || chr(31) || key), 1, 20) AS memory_id, source, session::BIGINT AS created_session, md5(text) AS text FROM i WHERE coalesce(text, '') <> ''
""")
def user_memory(spark: SparkSession, d: str) -> DataFrame:
    """The memory that a policy may see of each user, and nothing of what is hidden."""
    return us.memory_of(us.users_of(table(spark, d, "conversations"))).select("user_id", "memory_id", "source", "created_session", F.md5("text").alias("text"))


@Q.query("""
    SELECT conv_id::VARCHAR AS id, md5(max_by(text, turn)) AS topic FROM conversations GROUP BY 1
""")
def hidden_topics(spark: SparkSession, d: str) -> DataFrame:
    """The evaluator's side of the same users."""
    e = us.evaluator_view(us.users_of(table(spark, d, "conversations")))
    return e.select("id", F.md5(F.col("subsequent_topics")[0]["topic"]).alias("topic"))


@Q.query("""
    SELECT 'regions' AS name, count(*) AS n, 5::BIGINT AS expected, count(*) = 5 AS ok FROM region UNION ALL SELECT 'nations', count(*), 25, count(*) = 25 FROM nation
    UNION ALL SELECT 'dialogues', count(DISTINCT conv_id), 18, count(DISTINCT conv_id) = 18 FROM conversations
""")
def cardinality_gate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id").distinct()
    return keys.cardinalities({"regions": (table(spark, d, "region"), 5), "nations": (table(spark, d, "nation"), 25), "dialogues": (c, 18)})


@Q.query("""
    SELECT a.n_name AS role_a, b.n_name AS role_b, lower(r_name) AS family FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name JOIN region ON r_regionkey = a.n_regionkey
""")
def shared_families(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return keys.shared_families(n, "n_name", "r_name")


@Q.query("""
    WITH RECURSIVE t AS (SELECT conv_id, turn, role, greatest(1, ceil(length(coalesce(text, '')) / 4))::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    l AS (SELECT conv_id, turn, 0::BIGINT AS i, 120::BIGINT AS left_over, '' AS action FROM t WHERE i = 1
          UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN t.role = 'user' AND t.tokens <= l.left_over THEN l.left_over - t.tokens ELSE least(120, l.left_over + 15) END,
                           CASE WHEN t.role = 'user' AND t.tokens <= l.left_over THEN 'RS' ELSE 'R0' END FROM l JOIN t ON t.conv_id = l.conv_id AND t.i = l.i + 1)
    SELECT conv_id, turn, action, left_over FROM l WHERE i > 0
""")
def budget_loop(spark: SparkSession, d: str) -> DataFrame:
    """A budget of tokens per dialogue: each choice depends on what the choices before it have left."""
    from tessera.functions.text import estimate_tokens

    def step(state: dict, row: dict) -> tuple[dict, dict]:
        if row["role"] == "user" and row["tokens"] <= state["left"]:
            left, action = state["left"] - row["tokens"], "RS"
        else:
            left, action = min(120, state["left"] + 15), "R0"
        return {"left": left}, {"action": action, "left_over": left}

    t = table(spark, d, "conversations").select("conv_id", "turn", "role", estimate_tokens(F.col("text")).alias("tokens"))
    return closed_loop(t, "conv_id", "turn", step, {"left": 120}, "action string, left_over long")
