"""Joint vectors of states and actions in each mode, and the ranker that is trained on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vectors as ve
from tessera.operators.actions import SOURCES
from tessera.operators.logistic import log_loss
from tessera.operators.pairgraph import decided_pairs
from tessera.plans import states as st
from tessera.plans.views import outcomes
from tessera.queries.facts import ACTIONS_SQL
from tessera.queries.panel import rounded
from tessera.queries.registry import Registry
from tessera.queries.states import _STATES
from tessera.queries.text import FINGERPRINT_SQL
from tessera.session import durable, table

Q = Registry()

#: Most terms of the vocabulary of these queries.
TERMS = 200
KEY = "state_id"


def states(spark: SparkSession, d: str) -> DataFrame:
    return st.feature_states(table(spark, d, "conversations"), table(spark, d, "embeddings"))


def train(rows: DataFrame) -> DataFrame:
    return rows.where("conv_id % 5 <> 0")


def long(vectors: DataFrame) -> DataFrame:
    """``state_id, action_id, column, value``: a row for each entry."""
    e = F.explode(F.arrays_zip("x.indices", "x.values"))
    return vectors.select(KEY, "action_id", e.alias("e")).select(KEY, "action_id", F.col("e.indices").alias("column"), F.round("e.values", 6).alias("value")).where("value <> 0")


def joint(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = durable(states(spark, d))
        space = ve.JointSpace.fit(train(rows), KEY, mode, TERMS)
        return long(space.transform(ve.legal_rows(rows)))

    query.__name__ = f"joint_{mode}"
    query.__doc__ = f"Vectors of all states and legal actions in the mode {mode}, fitted on four fifths of the conversations."
    return query


_ZEROS = f"list_transform(range({st.PLACES}), lambda i: 0.0::DOUBLE)"
_FEATURES = f"""{_STATES}, {ACTIONS_SQL}, kv AS (SELECT vec_id, embedding[1:{st.PLACES}]::DOUBLE[] AS v FROM embeddings WHERE vec_id < {st.CATALOGS}),
    fs AS (SELECT s.state_id, s.conv_id, s.turn, s.text, s.available, s.conv_id % 5 <> 0 AS train, {", ".join(f"s.{s}_{f}" for s in SOURCES for f in ("count", "newest", "oldest", "tokens"))},
                  {", ".join(f"CASE WHEN s.{s}_count > 0 THEN coalesce(k{s}.v, {_ZEROS}) ELSE {_ZEROS} END AS {s}_catalog" for s in SOURCES)}, coalesce(ke.v, {_ZEROS}) AS embedding
           FROM states s {" ".join(f"LEFT JOIN kv k{s} ON k{s}.vec_id = (s.conv_id * 3 + {k}) % {st.CATALOGS}" for k, s in enumerate(SOURCES))} LEFT JOIN kv ke ON ke.vec_id = (s.conv_id * 7 + s.turn) % {st.CATALOGS}),
    ra AS (SELECT fs.*, action_id, mask, (strategy = 'RS')::INT::DOUBLE AS rs, n_sources::DOUBLE AS ns, {", ".join(f"(mask & {b} > 0)::INT::DOUBLE AS sel_{s}" for s, b in SOURCES.items())} FROM fs JOIN actions ON mask & available = mask)"""


def joint_sql(mode: str) -> str:
    text, metadata, catalog = ve.MODES[mode]
    capped = mode == "text_metadata_stable"

    def number(c: str, name: str) -> str:
        x = f"coalesce({c}, 0)::DOUBLE"
        return f"ln(1 + {f'least({x}, cap_{name})' if capped else x})"

    cols = []
    for s in SOURCES:
        cols.append(f"sel_{s}")
        if metadata:
            n = {f: number(f"{s}_{f}", f"{s}_{f}") for f in ve.FIELDS}
            cols += [f"({s}_count > 0)::INT", *[n[f] for f in ve.FIELDS], f"sel_{s} * {n['count']}", f"sel_{s} * {n['tokens']}"]
        if catalog:
            near = f"coalesce(CASE WHEN list_dot_product(q, q) > 0 AND list_dot_product({s}_catalog, {s}_catalog) > 0 THEN list_cosine_similarity(q, {s}_catalog) END, 0)"
            cols += [near, f"sel_{s} * {near}"]
    cols += ["rs", "ns", "ns * ns"] + ([number("turn", "session")] if metadata else [])
    dense = "[" + ", ".join(f"({c})::DOUBLE" for c in cols) + "]"
    for s in SOURCES if catalog else ():
        dense = f"list_concat({dense}, {s}_catalog, list_transform({s}_catalog, lambda x: x * sel_{s}))"
    caps = ", ".join([f"max(coalesce({s}_{f}, 0))::DOUBLE AS cap_{s}_{f}" for s in SOURCES for f in ve.FIELDS] + ["max(turn)::DOUBLE AS cap_session"])
    finger = FINGERPRINT_SQL.format(key="state_id", text="text", rows="fs", size=st.PLACES).replace("w AS (", "fw AS (", 1).replace("FROM w", "FROM fw").replace(" w.id", " fw.id").replace("g AS (", "fg AS (", 1).replace("FROM g", "FROM fg").replace("c AS (SELECT id,", "fc AS (SELECT id,", 1).replace("FROM c ", "FROM fc ")
    out = f"""WITH {_FEATURES}, caps AS (SELECT {caps} FROM fs WHERE train), {finger},
    dn AS (SELECT state_id, action_id, train, {dense} AS v FROM ra JOIN (SELECT id AS state_id, vector AS q FROM fp) USING (state_id), caps),
    de AS (SELECT state_id, action_id, train, unnest(v) AS v, unnest(range(len(v))) AS i FROM dn), lim AS (SELECT i, min(v) AS lo, max(v) AS hi FROM de WHERE train GROUP BY 1),
    al AS (SELECT state_id, action_id, i AS "column", greatest(lo, v) AS value FROM de JOIN lim USING (i) WHERE false UNION ALL SELECT state_id, action_id, i, least(hi, greatest(lo, v)) FROM de JOIN lim USING (i)"""
    if text:
        out = out.replace("WITH ", f"""WITH tw AS (SELECT 'state_' || substr(sha256(conv_id || chr(31) || turn), 1, 16) AS id, conv_id % 5 <> 0 AS train, regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_]+') AS t FROM conversations WHERE role = 'user'),
        tg AS (SELECT id, train, unnest(t) AS term FROM tw UNION ALL SELECT id, train, t[i] || ' ' || t[i + 1] FROM (SELECT *, unnest(range(1, len(t))) AS i FROM tw)),
        tf AS (SELECT id, train, term, count(*) AS n FROM tg GROUP BY ALL), vo AS (SELECT term, count(*) AS df FROM tf WHERE train GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT {TERMS}),
        vi AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS k, ln((1 + (SELECT count(*) FROM tw WHERE train)) / (1 + df)) + 1 AS idf, count(*) OVER () AS nt FROM vo),
        te AS (SELECT id, k, nt, (1 + ln(n)) * idf AS w FROM tf JOIN vi USING (term)), tn AS (SELECT id AS state_id, k, nt, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM te), """, 1)
        gates = ", ".join([f"sel_{s}" for s in SOURCES] + ["rs"])
        out += f" UNION ALL SELECT state_id, action_id, (SELECT count(*) FROM lim) + gate * nt + k, w FROM (SELECT state_id, action_id, unnest([{gates}]) AS open, unnest([0, 1, 2, 3]) AS gate FROM ra) JOIN tn USING (state_id) WHERE open > 0"
    return out + ') SELECT state_id, action_id, "column"::INT AS "column", round(value, 6) AS value FROM al WHERE round(value, 6) <> 0'


for _mode in ve.MODES:
    Q[f"joint_{_mode}"] = (joint(_mode), joint_sql(_mode))

#: Hashed words and characters of this query (the operator's defaults are 256 each).
WORDS = CHARS = 64
_TEXT = WORDS + CHARS + st.PLACES


def _robust_sql() -> str:
    log = lambda x: f"ln(1 + greatest(coalesce({x}, 0), 0))"
    meta = [log("turn")]
    for s in SOURCES:
        c = f"{s}_catalog"
        meta += [f"({s}_count > 0)::INT", log(f"{s}_count"), log(f"{s}_newest"), log(f"({s}_newest + {s}_oldest) / 2"), log(f"{s}_oldest"), log(f"{s}_tokens"), f"{c}[1]", f"coalesce(({s}_oldest >= 4)::INT, 0)"]
        meta += [f"sqrt(list_dot_product({c}, {c}))", f"list_avg({c})", f"sqrt(greatest(list_dot_product({c}, {c}) / len({c}) - list_avg({c}) ** 2, 0))"]
    meta += [log("conv_id % 9"), log("40 + conv_id % 30")]
    tokens = " + ".join(f"sel_{s} * coalesce({s}_tokens, 0) / greatest(coalesce({s}_count, 0), 1) * least(coalesce({s}_count, 0), {n})" for s, n in ve.TAKEN.items())
    act = [*[f"sel_{s}" for s in SOURCES], "rs", "ns", "ns * ns", f"ln(1 + greatest({tokens} + rs * (40 + conv_id % 30), 0))", "ns + rs"]
    as_list = lambda xs: "[" + ", ".join(f"({x})::DOUBLE" for x in xs) + "]"
    finger = FINGERPRINT_SQL.format(key="state_id", text="text", rows="fs", size=WORDS).replace("w AS (", "fw AS (", 1).replace("FROM w", "FROM fw").replace(" w.id", " fw.id").replace("g AS (", "fg AS (", 1).replace("FROM g", "FROM fg").replace("c AS (SELECT id,", "fc AS (SELECT id,", 1).replace("FROM c ", "FROM fc ")
    return f"""WITH {_FEATURES}, {finger},
        cw AS (SELECT state_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS w FROM fs),
        cg AS (SELECT state_id, ('0x' || substr(md5(substr(' ' || w || ' ', i, n)), 1, 8))::BIGINT % {CHARS} AS i FROM cw, (SELECT unnest([3, 4, 5]) AS n), LATERAL (SELECT unnest(range(1, greatest(length(w) + 4 - n, 1))) AS i)),
        cc AS (SELECT state_id, i, count(*) AS c FROM cg GROUP BY 1, 2),
        tx AS (SELECT id AS state_id, unnest(range({WORDS})) AS i, unnest(vector) AS v FROM fp UNION ALL SELECT state_id, {WORDS} + i, c / sqrt(sum(c * c) OVER (PARTITION BY state_id)) FROM cc
               UNION ALL SELECT state_id, unnest(range({WORDS + CHARS}, {_TEXT})), unnest(list_transform(embedding, lambda x: x / n)) FROM (SELECT *, coalesce(nullif(sqrt(list_dot_product(embedding, embedding)), 0), 1) AS n FROM fs)),
        me AS (SELECT state_id, train, unnest(range({len(meta)})) AS i, unnest(v) AS v FROM (SELECT state_id, train, {as_list(meta)} AS v FROM fs)),
        mq AS (SELECT i, quantile_cont(v, 0.5) AS m, coalesce(nullif(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 0), 1) AS s FROM me WHERE train GROUP BY 1),
        al AS (SELECT state_id, action_id, i, v FROM ra JOIN tx USING (state_id) UNION ALL SELECT state_id, action_id, {_TEXT} + i, (v - m) / s FROM ra JOIN me USING (state_id) JOIN mq USING (i)
               UNION ALL SELECT state_id, action_id, unnest(range({_TEXT + len(meta)}, {_TEXT + len(meta) + 8})), unnest({as_list(act)}) FROM ra
               UNION ALL SELECT state_id, action_id, {_TEXT + len(meta) + 8} + gate * {_TEXT} + i, v FROM (SELECT state_id, action_id, unnest([{", ".join(f"sel_{s}" for s in SOURCES)}, rs]) AS open, unnest([0, 1, 2, 3]) AS gate FROM ra) JOIN tx USING (state_id) WHERE open > 0)
        SELECT state_id, action_id, i::INT AS "column", round(v, 6) AS value FROM al WHERE round(v, 6) <> 0"""


@Q.query(_robust_sql())
def robust_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the second schema: hashed text, scaled metadata, action and interactions."""
    rows = durable(states(spark, d))
    space = ve.RobustSpace.fit(train(rows), KEY, WORDS, CHARS)
    return long(space.transform(ve.legal_rows(rows)))


@Q.query()
def vector_ranker(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: a ranker trained on the joint vectors of labelled states along the pair graph; accuracy and log-loss on held-out conversations."""
    rows = durable(states(spark, d))
    card = (F.col("conv_id") * 8 + F.col("turn") + 1).alias("card_id")
    labels = durable(rows.select(KEY, "conv_id", card).join(outcomes(spark, d).select("card_id", "action_id", "response"), "card_id"))
    space = ve.JointSpace.fit(train(rows), KEY, "text_metadata", 40)
    x = durable(space.transform(labels.select(KEY, "action_id").join(rows, KEY)))
    pairs = durable(decided_pairs(labels, KEY, "response").join(rows.select(KEY, "conv_id"), KEY))
    weights = ve.fit_ranker(x, train(pairs).drop("conv_id"), KEY, space.size)
    held = ve.pair_differences(x, pairs.where("conv_id % 5 = 0").drop("conv_id"), KEY)
    p = 1 / (1 + F.exp(-ve.dot("x", weights)))
    scored = held.select("label", p.alias("p"))
    right = ((F.col("p") > 0.5) == (F.col("label") == 1)).cast("double")
    return rounded(scored.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(log_loss(F.col("label"), F.col("p"))).alias("log_loss")))
